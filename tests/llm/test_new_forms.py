"""Fill-in-the-middle, the size-aware join and the repair of conversations against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest

from strokeline.llm import dialogue, heavylight, infill, queries

from test_duplicates import components_of, near_copies

DATA = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rearranged(i, text):
    """(n, form, prefix_chars, middle_chars, output) by a regular expression over the whole text."""
    text = text or ""
    h = [int(sha(f"1:{'' if i is None else i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_masks_and_ranked_bits():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("aZ é你😀 \n<P1") for _ in range(rng.randint(1, 70)))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        tokens, firsts = infill.masks(text.encode())
        width = len(text.encode())
        assert (tokens.bit_count(), firsts.bit_count()) == (len(units), len(text))
        ranks = sorted(rng.randint(0, len(units)) for _ in range(3))
        assert infill.boundaries(tokens, width, len(units), ranks) == [len("".join(units[:r]).encode()) for r in ranks]


def test_fill_in_middle_equals_regular_expressions(spark, odd, odd_rows):
    extra = [(n, t, "x") for n, t in enumerate(["<P> stays", "a<S", "M>b <M", "<", "<<M>>", "ab" * 9, "é" * 40, "P>x<S y<M", "\r\n\x00 z"] * 6, 500)]
    columns = odd.columns
    rows = [(*r, *[7] * (len(columns) - 3)) for r in odd_rows + extra]
    made = infill.fill_in_middle(spark.createDataFrame(rows, odd.schema))
    back = infill.restored(made.output, made.form)
    found = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.select("*", back.alias("back")).collect())
    assert found == Counter((i, *rearranged(i, t), t or "") for i, t, _ in odd_rows + extra)
    assert {k[2] for k in found} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing(empty):
    made = infill.fill_in_middle(empty)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and made.count() == 0


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (3, 60), (1, 50), (2, 100)])
def test_similar_texts_equal_brute_force(spark, odd_rows, size, percent):
    rng = random.Random(size)
    rows = near_copies(240, 4) + [(i if i is None else i + 10_000, t) for i, t, _ in odd_rows]
    few = [f"v{k}" for k in range(5)]  # sets of a few elements, some linked at need 1
    rows += [(20_000 + n, " ".join(rng.choice(few) for _ in range(rng.randint(1, 9)))) for n in range(80)]
    made = heavylight.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), shingle=size, percent=percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in made) == Counter(components_of(rows, size, percent))


@pytest.mark.parametrize("boundary", [0, 40, 1 << 62])
def test_subsets_and_lists_find_the_same(spark, monkeypatch, boundary):
    monkeypatch.setattr(heavylight, "_boundary", lambda prefixes, percent: boundary)
    rows = near_copies(240, 7) + [(1_000 + n, " ".join(f"w{(n * 7 + k) % 30}" for k in range(n % 40))) for n in range(60)]
    made = heavylight.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in made) == Counter(components_of(rows, 3, 85))


def test_chains_of_near_copies(spark):
    """Each text is like its neighbours only, so that no centre is like all members, and rounds and pairs are needed."""
    rows = []
    for chain in range(3):
        window = [f"c{chain}x{k}" for k in range(60)]
        for n in range(50):
            rows.append((len(rows), " ".join(window)))
            window = [*window[2:], f"c{chain}y{2 * n}", f"c{chain}y{2 * n + 1}"]
    rows += [(900 + n, " ".join([*(f"line{k}" for k in range(40)), *(f"own{n}x{k}" for k in range(40))])) for n in range(60)]  # one passage, nothing linked
    made = heavylight.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in made) == Counter(components_of(rows, 3, 85))


def test_similar_texts_of_odd_tables(odd, empty):
    assert heavylight.similar_texts(empty).count() == 0
    assert heavylight.similar_texts(odd).columns == ["doc_id", "n_shingles", "component_id"]


# --- conversations


def damaged(rows):
    made = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        made += [(c, t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return made


def repaired(turns):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) by Dijkstra's algorithm over (cost, audit)."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in turns:
        solid = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    numbers = [t for t, _, _ in turns if t is not None]
    count = Counter(faults)
    initials = [role[:1] for _, role, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, settled = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, lines = heapq.heappop(queue)
        if (at, state) in settled:
            continue
        settled.add((at, state))
        if at == len(turns) and state in ("", "a"):
            break
        for role in ("user", "assistant"):
            if after := follow.get((state, role[0])):
                heapq.heappush(queue, (cost + 3, audit + "I", at, after, (*lines, f"{role}:")))
        if at < len(turns):
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state, lines))
            if faults[at] in ("", "truncated"):
                more, (_, own, text) = 3 * (faults[at] == "truncated"), turns[at]
                if after := follow.get((state, own[:1])):
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, after, (*lines, f"{own}:{text}")))
                for role in ("user", "assistant"):
                    if after := follow.get((state, role[0])):
                        heapq.heappush(queue, (cost + 3 + more, audit + "R", at + 1, after, (*lines, f"{role}:{text}")))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(lines))


def odd_conversations():
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "", None, "useless"]
    texts = ["Yes.", "No", "Why?", "", " \t", None, "End!  \n", "ü.", "a. b", "\x85", "x" * 5_000 + "."]
    rows = [(c, rng.choice([None, *range(n)]), rng.choices(roles, [9, 9, 3, 1, 1, 1, 1])[0], rng.choice(texts)) for c in range(120) for n in [rng.randint(1, 14)] for _ in range(n)]
    rows += [(None, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(6)]
    rows += [(777, None, "user", "all null."), (777, None, "user", "all null."), (778, 5, "system", "only system.")]
    return rows + [(999, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"t{t}.", ""])) for t in range(700)]


@pytest.mark.parametrize("bits", [12, 2])
def test_repairs_equal_brute_force(spark, bits):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, k int, g int, b int")
    made = dialogue.repair_conversations(df, block_bits=bits).collect()
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    assert len(made) == len(by)
    assert {r.conv_id: tuple(r)[1:] for r in made} == {c: repaired(turns) for c, turns in by.items()}


def test_damaged_conversations(spark):
    rows = [r for r in odd_conversations() if r[2] != ""]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, dialogue.damage_conversations(df).collect()), key=key) == sorted(damaged(rows), key=key)


def test_every_conversation_has_a_row(spark):
    rows = [tuple(r) for r in queries.table(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    left = {}
    for c, *turn in damaged(rows):
        left.setdefault(c, []).append(tuple(turn))
    found = {r.conv_id: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, DATA).collect()}
    assert found == {c: repaired(left.get(c, [])) for c in {r[0] for r in rows}}


def test_no_conversations(spark):
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.repair_conversations(dialogue.damage_conversations(nothing)).count() == 0
    lone = spark.createDataFrame([(5,)], "conv_id long")
    assert [tuple(r) for r in dialogue.for_all(lone, dialogue.repair_conversations(nothing)).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", sha(""))]
