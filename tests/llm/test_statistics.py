import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strokeline.llm import langid, lm, quality, sharding, toxicity
from strokeline.llm.queries import TOKENIZERS, remainder

WORD = "[^ \t-\r]+"


def stats_of(text):
    words = re.findall(WORD, text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 5))
    seen, doubled = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text or ""), doubled, len(covered)


def test_statistics_equal_brute_force(odd, odd_rows):
    rows = quality.text_stats(odd).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=repr) == sorted(((i, *stats_of(t)) for i, t, _ in odd_rows), key=repr)


def test_statistics_of_lines():
    texts = ["a b\na b\n\n\nc\na b", "a b c d e a b c d e", "x# |y| <z>\n#", "a a a a a a a"]
    made = quality._stats(pa.array(texts))
    assert [tuple(int(x[n]) for x in made[:5]) for n in range(len(texts))] == [stats_of(t) for t in texts]


def test_decision_list_finds_planted_rules_and_spares_the_rest():
    rng = np.random.default_rng(0)
    rows = {"a": rng.random(4000), "b": rng.random(4000)}
    bad = (rows["a"] > 0.9) | ((rows["b"] < 0.1) & (rows["a"] > 0.3))
    found = quality.learn_decision_list(rows, bad)
    held = np.zeros(4000, dtype=bool)
    for rule in found.rules:
        held |= rule.holds(rows)
    assert (held & bad).sum() > 0.95 * bad.sum() and (held & ~bad).sum() < 0.01 * (~bad).sum()
    assert quality.learn_decision_list(rows, np.zeros(4000, dtype=bool)).rules == ()


def test_quality_verdicts(spark, odd, empty):
    junk = [(1000 + n, "%%% $$$ " * 20 + f"w{n}", "en") for n in range(60)]
    good = [(2000 + n, " ".join(f"w{(n * 7 + k) % 997}" for k in range(60)), "en") for n in range(120)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in junk + good], "doc_id long, text string"))
    labels = spark.createDataFrame([(r[0], 0) for r in junk] + [(r[0], 1) for r in good] + [(None, 0), (1000, None)], "doc_id long, quality int")
    stats = quality.text_stats(docs)
    rules = quality.train_quality(stats, labels)
    kept = {r.doc_id: r.kept for r in quality.quality_verdicts(stats, rules).collect()}
    assert not any(kept[r[0]] for r in junk) and all(kept[r[0]] for r in good) and not kept[100] and not kept[107]
    none = quality.train_quality(quality.text_stats(empty), labels.limit(0))
    assert quality.quality_verdicts(quality.text_stats(empty), none).collect() == []


def lm_brute(rows, trains, priors):
    """Scores by n-gram counters: no hashes, blocks, states or arcs."""
    tokens = [re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["\0end"] for _, t, *_ in rows]
    grams, one, starts = Counter(), Counter(), 0
    for ts, train in zip(tokens, trains):
        if train:
            starts += 1
            one.update(ts)
            line = ["\0start", *ts]
            grams.update(tuple(line[n : n + k]) for k in range(2, len(priors) + 2) for n in range(len(line) - k + 1))
    n, v = sum(one.values()), len(one)

    def p(history, w):
        if not history:
            return (one[w] + 1) / (n + v + 1)
        prior, seen = priors[len(history) - 1], grams[history] if len(history) > 1 else starts if history == ("\0start",) else one[history[0]]
        return (grams[(*history, w)] + prior * p(history[1:], w)) / (seen + prior)

    out = []
    for (i, *_), ts in zip(rows, tokens):
        line = ["\0start", *ts]
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ts)
        score = sum(math.log10(p(tuple(line[max(0, k - len(priors)) : k]), line[k])) for k in range(1, len(line)))
        out.append((i, len(ts), sum(one[w] > 0 for w in ts), n, base, score))
    return out


@pytest.mark.parametrize("priors", [(5.0,), (5.0, 2.0), (5.0, 2.0, 0.5)])
def test_language_model_equals_brute_force(odd, odd_rows, monkeypatch, priors):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2_000)
    trains = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, *_ in odd_rows]
    made = lm.score_texts(odd, F.coalesce(remainder("doc_id", 7) != 2, F.lit(True)), order=len(priors) + 1, prior=priors).collect()
    expected = lm_brute(odd_rows, trains, priors)
    key = lambda r: (repr(r[0]), r[1], round(r[5], 6))
    for mine, right in zip(sorted(map(tuple, made), key=key), sorted(expected, key=key), strict=True):
        assert mine[:4] == right[:4] and mine[4] == pytest.approx(right[4]) and mine[5] == pytest.approx(right[5])


def automaton_of(texts, training, order, prior):
    tokens, offsets, hashes = lm.tokens_of(pa.array(texts))
    block = lm.Block.of(tokens, offsets, hashes, np.array(training), order)
    counts = [x.own.astype(np.int64) for x in block.levels]
    return block, lm.Automaton(block, counts, int(counts[0].sum()), int((counts[0] > 0).sum()), sum(training), (prior,) * (order - 1))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_is_normalised(order):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(40)]
    vocabulary = ["a", "b", "c"]
    probes = [" ".join(["a", "b", w]) for w in [*vocabulary, "new"]] + ["a b"]
    block, machine = automaton_of(texts + probes, [True] * len(texts) + [False] * len(probes), order, 3.0)
    weights = 10 ** machine.read(block.tokens, block.offsets)
    third = [weights[block.offsets[len(texts) + n] + 2] for n in range(5)]  # a, b, c, an unknown word and the end, after "a b"
    assert sum(third) == pytest.approx(1.0)


def test_lanes_of_a_long_text_read_as_one_traversal(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (0, 1, 700, 1, 33)]
    block, machine = automaton_of(texts, [True, False, True, True, False], 3, 1.0)
    whole = machine.read(block.tokens, block.offsets)
    monkeypatch.setattr(lm, "_LANE", 5)
    assert np.allclose(machine.read(block.tokens, block.offsets), whole)
    # the failure arcs of a state lead to the state without the context's first word
    assert machine.fail[lm.ROOT] == machine.fail[lm.START] == lm.ROOT and (machine.fail_weight[1:] <= 0).all()


def test_language_model_of_an_empty_table(empty):
    assert lm.score_texts(empty, F.lit(True)).collect() == []


def test_forward_sums_all_segmentations():
    vocabulary = langid.Vocabulary(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "c"])
    p = np.random.default_rng(0).random((vocabulary.size, 2))
    place = {x: n for n, x in enumerate(vocabulary.pieces)}

    def total(word, g):
        if not word:
            return 1.0
        found = sum(p[place[word[:n]], g] * total(word[n:], g) for n in range(1, 4) if len(word) >= n and word[:n] in place)
        return found + (p[vocabulary.unknown, g] * total(word[1:], g) if word[0] not in place else 0)

    words = ["▁abab", "▁a", "▁xyab", "▁cc", "▁"]
    got = langid.word_log_likelihoods(pa.array(words), vocabulary, p)
    assert np.allclose(got, [[math.log(total(w, g)) for g in (0, 1)] for w in words])
    counts = langid.expected_counts(pa.array(["▁a"]), np.ones((1, 2)), vocabulary, p)
    whole, apart = p[place["▁a"]], p[place["▁"]] * p[place["a"]]
    assert np.allclose(counts[place["▁a"]], whole / (whole + apart)) and np.allclose(counts[place["a"]], apart / (whole + apart))


def test_words_of_any_length_over_the_whole_vocabulary():
    vocabulary = langid.sentencepiece_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    longest = max(map(len, vocabulary.pieces))
    assert vocabulary.size > 30_000 and vocabulary.longest == longest > 8
    p = np.random.default_rng(0).dirichlet(np.ones(vocabulary.size) * 0.1, size=2).T + 1e-9
    place = {x: n for n, x in enumerate(vocabulary.pieces)}

    def log_total(word, g):
        sums = [0.0]
        for end in range(1, len(word) + 1):
            terms = [sums[end - n] + math.log(p[place[word[end - n : end]], g]) for n in range(1, min(longest, end) + 1) if word[end - n : end] in place]
            if word[end - 1] not in place:
                terms.append(sums[end - 1] + math.log(p[vocabulary.unknown, g]))
            sums.append(max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms)))
        return sums[-1]

    texts = ["information", "international", "x" * 31, "understanding" * 4, "donaudampfschifffahrtsgesellschaft", "ab" * 300, "\U0001f600", "constitutional" * 50]
    words = ["▁" + t for t in texts]
    expected = np.array([[log_total(w, g) for g in (0, 1)] for w in words])
    assert np.allclose(langid.word_log_likelihoods(pa.array(words), vocabulary, p), expected)
    # expected counts are the slope of the likelihood: the pieces of all segmentations, weighted, make up the word
    counts = langid.expected_counts(pa.array(words), np.ones((len(words), 2)), vocabulary, p)
    sizes = np.array([*map(len, vocabulary.pieces), 1])
    assert np.allclose(sizes @ counts, sum(map(len, words)))


def test_too_many_languages_are_an_error(spark):
    docs = spark.createDataFrame([(n, "a text", f"l{n}") for n in range(12)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 10"):
        langid.train_languages(docs, langid.Vocabulary(["a"]), max_languages=10)


def test_hash_table_of_pieces_finds_exactly_the_vocabulary():
    pieces = [f"{a}{b}{c}" for a in "abcdefgh" for b in "▁ijklmn" for c in "opqrstuv"]
    vocabulary = langid.Vocabulary(pieces)
    points, offsets = langid._code_points(pa.array(pieces + ["zzz", "ab", "iop"]))
    value, key = langid._scrambled(points), np.zeros(len(pieces) + 3, dtype=np.uint64)
    for n in range(3):
        more = np.diff(offsets) > n
        key[more] = key[more] * langid._BASE + value[offsets[:-1][more] + n]
    assert vocabulary.ids(key).tolist() == [sorted(pieces).index(x) for x in pieces] + [-1] * 3


def test_language_predictions(spark, odd, odd_rows, empty):
    rng = random.Random(2)
    kinds = {"en": "the of and with that from this house water".split(), "de": "der die und nicht schön über ein Straße Wasser".split(), "fr": "le la et dans être où déjà maison eau".split()}
    rows = [(5000 + n, " ".join(rng.choice(kinds[g]) for _ in range(rng.randint(3, 40))), g) for n, g in enumerate(["en", "de", "fr"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train_languages(docs, langid.sentencepiece_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model"), where=F.col("doc_id") < 5090)
    found = {r.doc_id: r for r in langid.identify_languages(docs, model).collect()}
    assert np.mean([found[i].lang_pred == g for i, _, g in rows if i >= 5090]) > 0.97
    other = langid.identify_languages(odd, model).collect()
    assert len(other) == len(odd_rows) and all(0 <= r.score <= 1 for r in other)
    assert {r.doc_id for r in other if r.lang_pred == "und"} == {100, 101, 102, 110, 111, None}
    kept = langid.keep_identified(odd, model, min_score=0.0)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - 6
    nothing = langid.train_languages(empty, model.vocabulary)
    assert langid.identify_languages(empty, nothing).collect() == [] and {r.lang_pred for r in langid.identify_languages(docs, nothing).collect()} == {"und"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_levenshtein_automata_equal_brute_force():
    terms, kinds = ["idiot", "worthless", "abcd", "disgusting", "réeux"], [1, 1, 1, 1, 2]
    lexicon = toxicity.Lexicon(terms, kinds, [1.0] * 5)
    rng = random.Random(3)
    forms = {"", "x", "idiots", "réeu", "réeuxab"}
    for _ in range(2500):
        form = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, max(0, len(form) - 1))
            if rng.random() < 0.4 and form:
                form.pop(at)
            elif rng.random() < 0.5:
                form.insert(at, rng.choice("abcdeiost"))
            elif form:
                form[at] = rng.choice("abcdeiost")
        forms.add("".join(form))
    forms = sorted(forms)
    kind, _ = lexicon.matches(pa.array(forms))
    for form, got in zip(forms, kind.tolist()):
        near = any(distance(form, t) <= toxicity.allowed(t) for t in terms[:4])
        assert got == (1 if form in terms[:4] else 2 if form.startswith("réeux") else 3 if near else 0), form


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon(["idiot"], [1], [1.0])
    made = toxicity.features(pa.array(["you idiot go away", 'he said "you idiot" to us', "", "idot idiot", "plain words"]), lexicon)
    assert made[0, 6] == 1 and made[1, 6] == 0 and made[1, 3] == 1 and not made[2].any() and made[3, 0] > made[0, 0] and not made[4].any()


def test_toxicity_is_learned(spark, odd, odd_rows, empty):
    rng = random.Random(4)
    plain = "river stone cloud bread window garden music paper winter summer".split()
    bad = ["blargface", "snortling"]
    rows, labels = [], []
    for n in range(400):
        toxic = n % 4 == 0
        text = [rng.choice(plain) for _ in range(rng.randint(10, 60))]
        if toxic:
            for _ in range(rng.randint(3, 6)):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((n, " ".join(text)))
        labels.append((n, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, marks, where=F.col("doc_id") < 300)
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((score[i] >= 0.5) == bool(y) for i, y in labels if i >= 300)
    typed = spark.createDataFrame([(1, "river blargfacd stone snortlinng cloud blarface bread snortlig window"), (2, "river stone cloud")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(typed, model).collect()}
    assert score[1] >= 0.5 > score[2]
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd, model).collect()) and toxicity.score_toxicity(odd, model).count() == len(odd_rows)
    none = toxicity.train_toxicity(empty, marks.limit(0))
    assert toxicity.score_toxicity(empty, none).collect() == []


@pytest.mark.parametrize("exact", [20, 100_000])
def test_shards(odd, odd_rows, exact):
    rows = sharding.shard_by_kd_tree(odd.select("doc_id", "text", "lang", F.lit("s").alias("source")).where("length(text) < 1000 or text is null"), shards=7, exact_rows=exact).collect()
    expected = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()) if t else 0) for i, t, _ in odd_rows if t is None or len(t) < 1000]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == sorted(expected, key=repr)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(7))
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    mean, largest = sum(sizes.values()) / 7, max(r.size for r in rows)
    assert all(abs(b - mean) <= 1.5 * largest for b in sizes.values())


def test_shards_of_a_hot_text_and_by_target(spark, empty):
    hot = [(n, "the same text in all of these rows", "en", "s") for n in range(600)] + [(n, f"text {n} of its own", "en", "s") for n in range(600, 900)]
    docs = spark.createDataFrame(hot, "doc_id long, text string, lang string, source string")
    sizes = Counter()
    for r in sharding.shard_by_kd_tree(docs, shards=8, exact_rows=50).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * 60
    assert len({r.shard for r in sharding.shard_by_kd_tree(docs, target_bytes=10_000).collect()}) == -(-sum(sizes.values()) // 10_000)
    assert sharding.shard_by_kd_tree(empty, shards=4).collect() == []


@pytest.mark.parametrize("exact", [1_000, 0])
def test_cuts_equal_a_brute_force_tree(spark, monkeypatch, exact):
    rng = random.Random(9)
    rows = [(n, "x" * int(rng.paretovariate(0.7) * 20) if n % 9 else "copy of one text", rng.choice("abcdd"), rng.choice(["en", "de", None])) for n in range(900)]
    rows += [(None, "copy of one text", "a", "en")] * 40 + [(7, "y", "b", None)] * 25
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    seen, kept = [], sharding.written

    def spy(df, name):
        made = kept(df, name)
        if not seen:
            seen.extend(made.collect())
        return made

    monkeypatch.setattr(sharding, "written", spy)
    made = sharding.shard_by_kd_tree(docs, shards=13, exact_rows=exact).collect()
    extents = lambda part: [(min(r.dims[d] for r in part), max(r.dims[d] for r in part)) for d in range(3)]
    whole = [(high - low) or 1.0 for low, high in extents(seen)]
    found = Counter()

    def grow(part, shards, first):
        if shards == 1:
            found.update((r.i, r.size, r.crc, first) for r in part)
            return
        spread = extents(part)
        d = max(range(3), key=lambda k: (spread[k][1] - spread[k][0]) / whole[k])
        low, width = spread[d][0], spread[d][1] - spread[d][0]
        scale = 65535 / width if width else 0.0
        key = lambda r: ((math.floor((r.dims[d] - low) * scale) << 32) | (r.text_hash & 0xFFFFFFFF), (r.row_hash % (1 << 64)) >> 8)
        part = sorted(part, key=key)
        goal, upto, cut = sum(r.size for r in part) * (shards // 2) / shards, 0, 0
        while upto + part[cut].size <= goal:
            upto += part[cut].size
            cut += 1
        cut += upto + part[cut].size - goal < goal - upto
        grow(part[:cut], shards // 2, first)
        grow(part[cut:], shards - shards // 2, first + shards // 2)

    grow(seen, 13, 0)
    assert found == Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in made)


def test_rows_alike_are_dealt_one_by_one(spark):
    alike = spark.createDataFrame([(None, "same text", "a", "en")] * 800, "doc_id long, text string, source string, lang string")
    made = sharding.shard_by_kd_tree(alike, shards=8).collect()
    assert set(Counter(r.shard for r in made).values()) == {100}
    assert all(sorted(r.slot for r in made if r.shard == k) == list(range(100)) for k in range(8))


def test_long_terms_match_themselves_and_their_misspellings():
    for n in (24, 25, 26, 27, 40, 300):
        term = ("abcdefghijklmnopqrstuvwxyz" * 12)[:n]
        lexicon = toxicity.Lexicon([term], [toxicity.WORD], [1.0])
        words = [term, term[:-1], term[1:], term[:5] + "z" + term[5:], term + "zzz", term[: n // 2], term[: n // 2] + "0" * 3 + term[n // 2 :]]
        assert lexicon.matches(pa.array(words))[0].tolist() == [toxicity.WORD, *[toxicity.FUZZY] * 3, 0, 0, 0]
        assert pickle.loads(pickle.dumps(lexicon)).matches(pa.array(words))[0].tolist() == lexicon.matches(pa.array(words))[0].tolist()


def test_labels_without_documents_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([(5, 0), (6, 1)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    assert toxicity.score_toxicity(docs, model).first().score < 0.01


def test_a_repeated_id_trains_once(spark):
    good = [(n, " ".join(f"w{(n * 7 + k) % 997}" for k in range(60))) for n in range(60)]
    junk = [(1000 + n, " ".join(f"%%{n}$${k}" for k in range(60))) for n in range(60)]
    docs = spark.createDataFrame(good + junk + [junk[0]] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in junk] + [(1000, 0)] * 50, "doc_id long, quality int")
    rules = quality.train_quality(quality.text_stats(docs), labels)
    assert rules.rules and sum(r.covered for r in rules.rules) == 60


def test_lexicons_have_no_limit(spark):
    """Seven hundred planted terms are all learned; repeated labels count once, and labels of both kinds don't train."""
    from strokeline.llm import toxicity

    rng = random.Random(21)
    spell = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(3)) + "qxz" + "".join(chr(97 + n // 26**k % 26) for k in range(3))
    terms = [spell(n) for n in range(700)]
    rows = []
    for n in range(400):
        planted = terms[n // 2 * 70 % 700 :][:70] if n % 2 else []
        rows.append((n, " ".join([*planted, *(f"word{rng.randint(0, 40)}" for _ in range(30))]), n % 2))
    sample = spark.createDataFrame([(t, y) for _, t, y in rows], "t string, y int")
    lexicon = toxicity.learn_lexicon(sample, 200, 200)
    covered = [t for t in terms if any(t == e or (k == toxicity.STEM and t.startswith(e)) for e, k in zip(lexicon.terms, lexicon.kinds))]
    assert covered == terms and len(lexicon.terms) > 300
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = [(i, y) for i, _, y in rows]
    plain = toxicity.train_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    more = toxicity.train_toxicity(docs.union(spark.createDataFrame([(900, "odd one")], docs.schema)), spark.createDataFrame(labels + labels[:50] * 3 + [(900, 0), (900, 1)], "doc_id long, toxic int"))
    assert plain.lexicon.terms == more.lexicon.terms and plain.bias == pytest.approx(more.bias)
