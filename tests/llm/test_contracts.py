"""The registered queries over whole tables: columns and laws that the contracts name, and SQL where it says the same."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strokeline.llm import quality, queries
from strokeline.llm.store import written

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
WORD = "[^ \t-\r]+"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in queries.table(spark, DATA, "documents").select("doc_id", "text").collect()}


def rest(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))


def test_shards(spark, texts):
    rows = queries.op1_kd_shards(spark, DATA).collect()
    assert {r.doc_id for r in rows} == set(texts) and {r.law for r in rows} == {"bytes"} and all(0 <= r.shard < 40 and r.grown_shard is None for r in rows)
    slots, size = defaultdict(list), Counter()
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data)
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # no shard is further from its share than the largest rows
    largest = sorted((r.size for r in rows), reverse=True)
    assert all(abs(size[s] - sum(size.values()) / 40) <= sum(largest[:6]) for s in range(40))


def test_quality(spark, texts):
    df = queries.op2_quality_rules(spark, DATA)
    rows = df.collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        words = re.findall(WORD, texts[r.doc_id] or "")
        count = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        inside = {k for i in range(len(words) - 4) if count[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(inside))
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    # the CASE expression says what the rules say, one after the other, in SQL
    stats = written(quality.text_stats(queries.table(spark, DATA, "documents")), "stats")
    rules = quality.train_quality(stats, queries.table(spark, DATA, "labels"))
    ratio = lambda f: "CAST({} AS DOUBLE)/greatest({}, 1)".format(*quality.RATIOS[f]) if f in quality.RATIOS else f
    junk = " OR ".join("(" + " AND ".join(f"{ratio(c.feature)} {'>' if c.above else '<='} {c.threshold!r}" for c in rule.conditions) + ")" for rule in rules.rules) or "FALSE"
    con = duckdb.connect()
    con.register("stats", stats.toPandas())
    expected = dict(con.execute(f"SELECT doc_id, NOT (n_words<10 OR 100*n_repeat_words>20*n_words) AND NOT ({junk}) FROM stats").fetchall())
    assert {r.doc_id: r.kept for r in rows} == expected


def test_language_model(spark, texts):
    tokens = {i: re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0"] for i, t in texts.items()}
    count = Counter(w for i, ws in tokens.items() if rest(i, 7) != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    rows = queries.op3_backoff_scores(spark, DATA).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ws = tokens[r.doc_id]
        assert r.held_out == (rest(r.doc_id, 7) == 2) and r.n_tokens == len(ws) and r.n_known == sum(count[w] > 0 for w in ws) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_toxicity(spark, texts):
    rows = queries.op6_toxicity(spark, DATA).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.held_out == (rest(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_languages(spark, texts):
    rows = queries.op10_language_id(spark, DATA).collect()
    langs = {r.lang for r in queries.table(spark, DATA, "documents").collect()} - {None}
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        lettered = any(ch.isalpha() for ch in texts[r.doc_id] or "")
        assert r.held_out == (rest(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and (r.lang_pred in langs if lettered else r.lang_pred == "und")


def test_codings(spark, texts):
    coder = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    coder.no_truncation()
    coder.no_padding()
    for r in queries.op9_bpe(spark, DATA).collect():
        ids = coder.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(coder.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_archived_digests(spark):
    html = {r.page_id: (r.html or "").encode() for r in queries.table(spark, DATA, "pages").collect()}
    rows = queries.op8_arc_to_warc(spark, DATA).collect()
    assert {r.page_id for r in rows} == set(html) and len(rows) == len(html)
    assert all(r.payload_digest == base64.b32encode(hashlib.sha1(html[r.page_id]).digest()).decode() for r in rows)
