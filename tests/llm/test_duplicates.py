import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strokeline.llm import components, decontaminate, neardup, sketch, spans

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, size):
    words = re.findall("[^ \t-\r]+", (text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*[words[i:] for i in range(size)]))


def components_of(rows, size, percent):
    """Smallest id of each row's group, over all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return [(i, len(sets[n]), least.get(find(n)) if sets[n] else i) for n, (i, _) in enumerate(rows)]


def near_copies(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(n // 12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("small", [64, 2])
def test_groups_equal_brute_force(spark, odd_rows, small):
    rows = near_copies(240, 1) + [(i if i is None else i + 10_000, t) for i, t, _ in odd_rows]
    made = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85, bands=24, rows=5, small_bucket=small).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in made), key=repr) == sorted(components_of(rows, 3, 85), key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in made)


def test_one_row_of_each_group_stays(spark, odd, odd_rows, empty):
    kept = neardup.keep_representatives(odd)
    assert kept.columns == odd.columns
    groups = Counter()
    rows = [(i, t) for i, t, _ in odd_rows]
    for (i, t), (_, n, c) in zip(rows, components_of(rows, 5, 80)):
        groups[(c, n > 0)] += 1
    expected = sum(1 if filled else n for (_, filled), n in groups.items())
    assert kept.count() == expected
    assert neardup.keep_representatives(empty).collect() == [] and neardup.near_duplicates(empty).collect() == []


def test_many_rows_of_one_id_and_of_none(spark):
    """Intermediate rows grow with the rows, not with the square of those that share an id."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(4000)}"
    base = [word() for _ in range(60)]
    rows = [(None, " ".join(base[:50] + [word() for _ in range(n % 7)])) for n in range(1500)] + [(7, " ".join(base))] * 1500 + [(None, None), (8, "")] * 50
    rows += [(100 + n, " ".join(word() for _ in range(30))) for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = neardup.near_duplicates(docs, shingle=3, percent=85, bands=24, rows=5).collect()
    assert len(made) == len(rows) and {r.component_id for r in made if r.doc_id == 7} == {7}
    kept = neardup.keep_representatives(docs, shingle=3, percent=85, bands=24, rows=5).groupBy("doc_id", "text").count().collect()
    assert sum(r["count"] for r in kept if r.doc_id == 7) == 1 and sum(r["count"] for r in kept if not r.text) == 100
    assert sum(r["count"] for r in kept if (r.doc_id or 0) >= 100) == 20


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    for size in (1, 3, 50, 3000):
        x = rng.integers(0, 2**63, size, dtype=np.uint64)
        y = x.copy()
        y[: size // 4] = rng.integers(0, 2**63, size // 4, dtype=np.uint64)
        made = sketch.sketches(np.concatenate([x, y]), np.array([0, size, 2 * size]), 128)
        assert (made != 0).all()
        truth = (size - size // 4) / (size + size // 4)
        assert abs((made[0] == made[1]).mean() - truth) < 0.2
    assert not sketch.sketches(np.zeros(0, np.uint64), np.array([0, 0]), 16).any()


def test_packed_overlap():
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64))
    assert sketch.overlap(sketch.packed(x), sketch.packed(x[100:])) == (400, 500)


def test_components_of_paths_and_stars(spark):
    edges = [(n, n + 1) for n in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, None)]
    made = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert made == {n: 0 for n in range(41)} | {n: 100 for n in range(100, 160)}


def sentences(text, longest):
    words = [(m.start(), m.end()) for m in re.finditer("[^ \t-\r]+", text)]
    out, now = [], []
    for n, (a, b) in enumerate(words):
        if now and (text[words[n - 1][1] - 1] in ".!?" or "\n" in text[words[n - 1][1] : a] or len(now) == longest):
            out.append(now)
            now = []
        now.append((a, b))
    return out + [now] if now else out


def spans_brute(rows, k, w, longest):
    """Each row is an occurrence of its own; rows alike in id and text come one after the other."""
    first, gone = {}, defaultdict(set)
    order = sorted((n for n, (_, t) in enumerate(rows) if t is not None), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, n))
    for n in order:
        text = rows[n][1]
        parts = sentences(text, longest)
        upto = [0]
        for s in parts:
            upto.append(upto[-1] + len(s))
        runs = {(a, next((b for b in range(a + k, len(parts) + 1) if upto[b] - upto[a] >= w), None)) for a in range(len(parts))}
        runs |= {(next((a for a in range(b - k, -1, -1) if upto[b] - upto[a] >= w), None), b) for b in range(1, len(parts) + 1)}
        for a, b in sorted(r for r in runs if None not in r):
            key = tuple(text[x:y].translate(LOWER) for s in parts[a:b] for x, y in s)
            if first.setdefault(key, (n, a)) != (n, a):
                gone[n] |= set(range(a, b))
    out = []
    for n, (i, text) in enumerate(rows):
        if text is None:
            out.append((i, None, 0, 0))
            continue
        parts, bad = sentences(text, longest), gone.get(n, set())
        kept = text if not bad else "".join(text[s[0][0] : parts[m + 1][0][0] if m + 1 < len(parts) else len(text)] for m, s in enumerate(parts) if m not in bad)
        out.append((i, kept.rstrip() if len(parts) - 1 in bad else kept, len(parts), len(bad)))
    return out


def test_spans_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spans, "SLICE", 3_000)
    rng = random.Random(6)
    passages = [" ".join(" ".join(rng.choice("abcdefghij") * 3 for _ in range(rng.randint(1, 12))) + "." for _ in range(6)) for _ in range(5)]
    rows = []
    for n in range(120):
        own = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 25))) + rng.choice([".", "!", "\n", ""]) for _ in range(rng.randint(0, 8))]
        if rng.random() < 0.5:
            own.insert(rng.randint(0, len(own)), rng.choice(passages))
        rows.append((n, " ".join(own)))
    rows += [rows[0], (500, rows[3][1]), (None, passages[0]), (501, None), (502, ""), (503, passages[1].upper() + " " + passages[1])]
    for remembered, partitions in ((1 << 19, 4096), (40, 3)):
        monkeypatch.setattr(spans, "_REMEMBERED", remembered)
        monkeypatch.setattr(spans, "MAX_PARTITIONS", partitions)
        made = spans.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), rows_per_bucket=10).collect()
        assert sorted(((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in made), key=repr) == sorted(spans_brute(rows, 2, 25, 20), key=repr)


def test_rows_alike_lose_their_repeats(spark):
    long_ = ". ".join(" ".join(f"w{n}x{k}" for k in range(15)) for n in range(4)) + "."
    short = "Two short sentences. Under twenty five words."
    rows = [(3, long_)] * 3 + [(None, "z " + long_)] * 2 + [(9, short), (9, short), (10, short)]
    made = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in spans.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert made == [(False, 3, ""), (False, 3, ""), (False, 3, long_), (False, 9, short), (False, 9, short), (False, 10, short), (True, 0, ""), (True, 0, "z w0x0 w0x1 w0x2 w0x3 w0x4 w0x5 w0x6 w0x7 w0x8 w0x9 w0x10 w0x11 w0x12 w0x13 w0x14.")]
    with pytest.raises(ValueError, match="n_removed"):
        spans.remove_repeated_spans(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, n_removed long"))


def kept_of_long_repeats(rows, made, least):
    """Of each maximal run of `least` words or more that a text shares with an earlier one: words that stay, by text. Words here don't repeat by chance."""
    seen, out = {}, []
    for i, text in rows:
        words, stays = text.split(), set(made[i].split())
        own = [tuple(words[p : p + least]) for p in range(len(words) - least + 1)]
        shared = [g in seen for g in own] + [False]
        begin = None
        for p, hit in enumerate(shared):
            if hit and begin is None:
                begin = p
            if not hit and begin is not None:
                out.append((i, sum(w in stays for w in words[begin : p - 1 + least])))
                begin = None
        for g in own:
            seen.setdefault(g, i)
    return out


def test_long_repeats_go_wherever_sentences_are_cut(spark):
    rng = random.Random(8)
    fresh = (f"x{n}" for n in range(10**6))
    rows, number = [], 0
    for ends in (0, 0, 0, 0.02, 0.05):
        for length in (51, 52, 60, 75, 120, 300):
            passage = [next(fresh) + ("." if rng.random() < ends else "") for _ in range(length)]
            for _ in range(3):
                before, after = ([next(fresh) for _ in range(rng.randint(0, 90))] for _ in range(2))
                rows.append((number, " ".join(before + passage + after)))
                number += 1
    made = {r.doc_id: r for r in spans.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = kept_of_long_repeats(rows, {i: r.text for i, r in made.items()}, 51)
    assert len(found) == 60 and max(n for _, n in found) <= 50
    assert all(made[i].n_removed > 0 for i, _ in found)
    for n, (i, text) in enumerate(rows):
        if n % 3 == 0:  # first occurrences stay, and of the others what stands around the passage
            assert made[i].text == text and made[i].n_removed == 0
        own = [w for w in text.split() if w not in rows[n - n % 3][1].split()]
        kept = made[i].text.split()
        assert n % 3 == 0 or [w for w in kept if w in set(own)] == own


def test_spans_over_odd_rows(odd, odd_rows, empty):
    made = spans.remove_repeated_spans(odd, counts=False)
    assert made.columns == odd.columns and made.count() == len(odd_rows)
    assert {r.text for r in made.where("doc_id in (100, 101, 102, 110)").collect()} == {None, "", "  \n\t ", "\n\n\n"}
    assert spans.remove_repeated_spans(empty).collect() == []


BENCH = ["Alice has 12 apples and gives Bob 5 of them. How many apples does Alice have now when Bob eats 5?", "A train travels 60 km in 2 hours. What is the average speed of the train over the whole journey?", None, ""]


def leaks(texts, coverage=0.5):
    return {(r[0], r[1], r[3]) for r in decontaminate.Benchmark.of([1, 2, 3, 4], pa.array([b or "" for b in BENCH]), 8, 4, 4).leaks(pa.array(texts), coverage)}


def test_reparameterised_questions_are_caught():
    assert leaks(["Well. Carol has 99 apples and gives Dave 7 of them. How many apples does Carol have now when Dave eats 7? Yes."]) == {(0, 0, True)}
    assert leaks(["x. A train travels 75 miles in 3 hours. What is the average speed of the train over the whole journey? y", BENCH[1]]) == {(0, 1, True), (1, 1, False)}
    assert leaks(["a train of thought about the average speed of things", "", "Apples and trains. Nothing else is here to see at all."]) == set()


def test_inconsistent_slots_do_not_count():
    made = templates = decontaminate.Benchmark.of([1], pa.array([BENCH[0]]), 8, 4, 4)
    (_, _, whole, _), = made.leaks(pa.array(["z. Carol has 9 apples and gives Dave 7 of them. How many apples does Carol have now when Dave eats 7?"]), 0.0)
    (_, _, part, _), = templates.leaks(pa.array(["z. Carol has 9 apples and gives Dave 7 of them. How many apples does Erin have now when Frank eats 3?"]), 0.0)
    assert part < whole


def test_every_copy_of_a_question_is_judged_by_itself():
    names = ["Carol", "Dave", "Erin", "Frank", "Grace", "Heidi", "Ivan", "Judy", "Mallory", "Oscar"]
    rng = random.Random(3)
    for copies in (1, 2, 3, 5, 10):
        for more in ("", " of the very ripe kind"):
            for _ in range(20):
                texts = []
                for _ in range(copies):
                    a, b = rng.sample(names, 2)
                    x, y = rng.sample(range(2, 99), 2)
                    texts.append(f"so {a} has {x} apples and gives {b} {y} of them. How many apples{more} does {a} have now when {b} eats {y}?")
                assert leaks([" ".join(texts)], 0.5 if more else 0.95) == {(0, 0, True)}
    assert leaks(["Well. Carol has 99 apples and gives Dave 7 of them. How many apples does Carol have now when Dave eats 7? And. " + BENCH[0]]) == {(0, 0, False)}


def test_a_name_that_opens_a_sentence_is_a_slot():
    bench = ["Alice has 12 apples and gives Bob 5 of them today. How many red apples does Alice keep?"]
    found = lambda text: [r[1:] for r in decontaminate.Benchmark.of([1], pa.array(bench), 8, 4, 4).leaks(pa.array([text]), 0.5)]
    assert found("Carol has 31 apples and gives Dave 7 of them today. How many red apples does Erin keep?") == []
    assert found("Carol has 31 apples and gives Dave 7 of them today. How many red apples does Carol keep?") == [(0, 1.0, True)]
    assert found("First, Carol has 31 apples and gives Dave 7 of them today. How many red apples does Carol keep?") == [(0, 1.0, True)]
    assert found(bench[0]) == [(0, 1.0, False)]
    assert found("alice " + bench[0].split(" ", 1)[1].lower().replace("alice", "Alice").replace("bob", "Bob")) == [(0, 1.0, False)]


def reparameterised_items(count, seed):
    """(items, texts that ask each with other numbers, names and units, texts that put a third person at the end), each item with words of its own order."""
    rng = random.Random(seed)
    names = ["Carol", "Dave", "Erin", "Frank", "Grace", "Heidi", "Ivan", "Judy", "Mallory", "Oscar", "Peggy", "Rupert", "Sybil", "Trent"]
    words = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    units = ["kg", "km", "hours", "litres", "meters"]
    items, asked, broken = [], [], []
    for _ in range(count):
        w = rng.sample(words, 14)
        left = rng.sample(names, len(names))  # an item's own names would make half of it verbatim
        for out in (items, asked, broken):
            x, y, z = rng.sample(range(2, 900), 3)
            a, b, c = (left.pop() for _ in range(3))
            start = f"{a} {w[0]} {x} {w[1]} {w[2]} {y} {rng.choice(units)} {w[3]} {b} {w[4]} {w[5]} {w[6]}. How {w[7]} {w[8]} {w[9]}"
            out.append(f"{start} {c if out is broken else a} {w[10]} {w[11]} {w[12]} {z} {w[13]}?")
    return items, asked, broken


def test_recall_of_reparameterised_questions():
    items, asked, broken = reparameterised_items(200, 5)
    known = decontaminate.Benchmark.of(list(range(200)), pa.array(items), 8, 4, 4)
    around = "Some words stand before it here. {} And some stand behind it."
    hits = {(r[0], r[1]) for r in known.leaks(pa.array([around.format(t) for t in asked]), 0.5)}
    assert sum((n, n) in hits for n in range(200)) >= 180
    assert hits <= {(n, n) for n in range(200)}
    assert known.leaks(pa.array([around.format(t) for t in broken]), 0.5) == []


def test_short_and_numeric_items(spark):
    bench = pa.array(["yes", "What is love?", "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9", "12 30"])
    made = decontaminate.Benchmark.of([0, 1, 2, 3], bench, 8, 4, 4)
    texts = ["Yes.", "yes it is", "what is love", "they ask what is love today", "digits: 3 1 4 1 5 9 2 6 5 3 5 8 9 7 9 end", "digits: 2 7 1 8 2 8 1 8 2 8 4 5 9 0 4 end", "12 30", "13 30"]
    assert {(r[0], r[1]) for r in made.leaks(pa.array(texts), 0.5)} == {(0, 0), (2, 1), (4, 2), (6, 3)}


def test_both_ways_find_the_same(spark, odd, odd_rows, empty, monkeypatch):
    bench = spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string")
    texts = [(1, "So. " + BENCH[0]), (2, "Ben has 3 apples and gives Ann 5 of them. How many apples does Ben have now when Ann eats 5?"), (3, "clean words of no matter at all here"), (4, None), (5, BENCH[1]), (5, BENCH[1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    few = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    assert {(r[0], r[1]) for r in few} == {(1, 0), (2, 0), (5, 1)}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == [3, 4]
    assert decontaminate.drop_leaks(odd, bench).columns == odd.columns and decontaminate.drop_leaks(odd, bench).count() == len(odd_rows)
    assert decontaminate.find_leaks(empty, bench).collect() == [] and decontaminate.find_leaks(docs, bench.limit(0)).collect() == []
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert sorted(set(map(tuple, decontaminate.find_leaks(docs, bench).collect()))) == sorted(set(few))
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == [3, 4]


def test_both_ways_find_equal_rows(spark, monkeypatch):
    bench = spark.createDataFrame([(1, BENCH[0]), (1, BENCH[1]), (1, BENCH[1]), (None, BENCH[0]), (None, "Seven small boats sail to the far harbour before the storm comes."), (3, "Six old owls hoot."), (4, None)], "item_id long, text string")
    clean = "clean words of no matter at all here"
    texts = [(1, "So. " + BENCH[0]), (1, clean), (1, "So. " + BENCH[0]), (None, clean), (None, BENCH[1]), (None, None), (2, "seven small boats sail to the far harbour before the storm comes. Six old owls hoot."), (5, BENCH[1]), (5, BENCH[1]), (6, clean)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    both = []
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
        both.append([sorted(map(repr, map(tuple, df.collect()))) for df in (decontaminate.find_leaks(docs, bench), decontaminate.drop_leaks(docs, bench))])
    assert both[0] == both[1]
    assert len(both[0][0]) == 2 * 2 + 3 * 2 + 2 and both[0][1] == sorted(map(repr, [(1, clean), (None, clean), (None, None), (6, clean)]))
