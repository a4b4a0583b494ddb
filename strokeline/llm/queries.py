"""The registered queries of the text operators: each takes (spark, folder of tables) and covers its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, dialogue, heavylight, infill, langid, lm, neardup, quality, sharding, spans, toxicity, warc
from .store import new_path, written

#: Where the tokenizer files of the queries are; another file is given by the operators' parameter.
TOKENIZERS = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo `modulus`; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def op1_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    made = sharding.shard_by_kd_tree(table(spark, folder, "documents"), shards=40)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Decision lists learned from `labels.quality`, applied to the statistics of all documents."""
    stats = written(quality.text_stats(table(spark, folder, "documents")), "op2-stats")
    rules = quality.train_quality(stats, table(spark, folder, "labels"), max_training_rows=20_000)
    made = quality.quality_verdicts(stats, rules)
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_backoff_scores(spark: SparkSession, folder: str) -> DataFrame:
    """log10 probabilities of all documents, under a model of those whose remainder modulo 7 is not 2."""
    docs = table(spark, folder, "documents")
    made = lm.score_texts(docs, training=F.coalesce(remainder("doc_id", 7) != 2, F.lit(True)))
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    return made.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it leaks, verbatim or with other numbers, names and units."""
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the sentences of repeated runs."""
    made = spans.remove_repeated_spans(table(spark, folder, "documents").select("doc_id", "text"))
    return made.select("doc_id", "text", "n_sentences", "n_removed")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels whose remainder modulo 5 is not 0."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = toxicity.train_toxicity(docs, labels, where=~held_out)
    made = toxicity.score_toxicity(docs, model)
    return made.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents with 3-word shingle sets of a similarity of 0.85 or more."""
    return neardup.near_duplicates(table(spark, folder, "documents"), shingle=3, percent=85, bands=24, rows=5)


def op8_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as ARC files, converted to WARC files of responses and revisits, and read back from these."""
    pages = table(spark, folder, "pages")
    records = warc.convert_arcs(written(warc.pack_arcs(pages, "page_id", "url", "html"), "arcs"))
    path = new_path(spark, "warc")
    warc.write_warc(warc.with_revisits(records, F.col("record_key").cast("bigint"), min_bytes=0), path, software="strokeline")
    made = warc.read_warc(spark, path, payloads=False).where("record_type <> 'warcinfo'")
    return made.select(
        F.col("record_key").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").cast("bigint").alias("refers_to")
    )


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    made = bpe.bpe_round_trip(table(spark, folder, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")
    return made.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from the rows whose remainder modulo 3 is not 1."""
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    vocabulary = langid.sentencepiece_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    model = langid.train_languages(docs, vocabulary, where=~held_out)
    made = langid.identify_languages(docs, model)
    return made.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document with its parts in another order, and of the text rebuilt from that."""
    made = infill.fill_in_middle(table(spark, folder, "documents"), seed="1", plain_percent=10, spm_percent=20)
    back = infill.restored(F.col("output"), F.col("form"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_similarity_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents with 4-word shingle sets of a similarity of 0.85 or more; every link is found."""
    return heavylight.similar_texts(table(spark, folder, "documents"), shingle=4, percent=85)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of all conversations, damaged by a hash of their turns."""
    turns = table(spark, folder, "conversations")
    made = dialogue.repair_conversations(dialogue.damage_conversations(turns))
    return dialogue.for_all(turns.select("conv_id").distinct(), made)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kd_shards": op1_kd_shards,
    "op2_quality_rules": op2_quality_rules,
    "op3_backoff_scores": op3_backoff_scores,
    "op4_benchmark_leaks": op4_benchmark_leaks,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_toxicity": op6_toxicity,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_arc_to_warc": op8_arc_to_warc,
    "op9_bpe": op9_bpe,
    "op10_language_id": op10_language_id,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_similarity_join": op12_similarity_join,
    "op13_conversation_repair": op13_conversation_repair,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE32 = _UPPER + "234567"
#: Four base32 digits of each five hexadecimal ones.
_DIGITS = " || ".join(f"substr('{_BASE32}', ((CAST(concat('0x', substr(h, {5 * g + 1}, 5)) AS BIGINT) >> {shift}) & 31) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))

#: CRC-32 of a text of ASCII characters, bit by bit.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda x: ord(x)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1)*3988292384))), 4294967295)"
#: The best ways from each state where up to two turns may be put in first.
_INSERTED = """list_transform([1,2,3,4], lambda q: list_min([{0}[q], struct_pack(c := {0}[[3,3,4,3][q]].c+3, a := 'I' || {0}[[3,3,4,3][q]].a, l := ['user','user','assistant','user'][q] || ':' || CASE WHEN {0}[[3,3,4,3][q]].l='' THEN '' ELSE chr(10) || {0}[[3,3,4,3][q]].l END),
  struct_pack(c := {0}[[4,4,3,4][q]].c+6, a := 'II' || {0}[[4,4,3,4][q]].a, l := ['user','user','assistant','user'][q] || ':' || chr(10) || ['assistant','assistant','user','assistant'][q] || ':' || CASE WHEN {0}[[4,4,3,4][q]].l='' THEN '' ELSE chr(10) || {0}[[4,4,3,4][q]].l END)]))"""


def _components(size: int, more: str) -> str:
    """SQL of documents linked by sets of `size`-word shingles with a similarity of 0.85 or more."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w)=0 THEN [] WHEN len(w)<{size} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)-{size}+2), lambda i: array_to_string(w[i:i+{size}-1], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x=b.x AND a.doc_id<b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN s p ON p.doc_id=a JOIN s q ON q.doc_id=b WHERE 100*n >= 85*(len(p.s)+len(q.s)-n)), g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, g.b FROM r JOIN g ON r.reached=g.a), m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id{more} FROM s JOIN m USING (doc_id)"""


#: SQL of the queries that SQL can express exactly; tests hold the others against brute force.
ORACLES: dict[str, str] = {
    "op7_near_duplicates": _components(3, ", doc_id=component_id AS kept"),
    "op11_fill_in_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(w)+1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(w)+1) AS c2,
  CASE WHEN t='' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain' WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT doc_id, t, n, form, array_to_string(w[1:least(c1, c2)], '') AS p, array_to_string(w[least(c1, c2)+1:greatest(c1, c2)], '') AS m, array_to_string(w[greatest(c1, c2)+1:], '') AS s FROM u)
SELECT doc_id, n, form, CASE WHEN form<>'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form<>'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
    "op12_similarity_join": _components(4, ""),
    "op13_conversation_repair": rf"""WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind=4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM m, (SELECT unnest([1, 2]) AS copy) WHERE kind<>0 AND (copy=1 OR kind=3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid, left(role, 1) AS i FROM d),
f AS (SELECT *, CASE WHEN solid='' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k)>1 THEN 'd' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY k) || i AS pair, CASE i WHEN 's' THEN [2,0,0,0] WHEN 'u' THEN [3,3,0,3] WHEN 'a' THEN [0,0,4,0] ELSE [0,0,0,0] END AS t FROM o),
w(conv_id, k, z) AS (SELECT conv_id, max(k)+1, [struct_pack(c := 0, a := '', l := ''), struct_pack(c := 1000000000, a := '', l := ''), struct_pack(c := 1000000000, a := '', l := ''), struct_pack(c := 0, a := '', l := '')] FROM f GROUP BY conv_id
  UNION ALL SELECT conv_id, k, list_transform([1,2,3,4], lambda q: list_min([struct_pack(c := b[q].c+4, a := 'D' || b[q].a, l := b[q].l),
    struct_pack(c := CASE WHEN fault IN ('b', 'd') OR t[q]=0 THEN 1000000000 ELSE b[t[q]].c+more END, a := coalesce('K' || b[t[q]].a, ''), l := coalesce(role || ':' || text || CASE WHEN b[t[q]].l='' THEN '' ELSE chr(10) || b[t[q]].l END, '')),
    struct_pack(c := CASE WHEN fault IN ('b', 'd') THEN 1000000000 ELSE b[n[q]].c+3+more END, a := 'R' || b[n[q]].a, l := r[q] || ':' || text || CASE WHEN b[n[q]].l='' THEN '' ELSE chr(10) || b[n[q]].l END)])) FROM (
    SELECT f.conv_id, f.k, f.role, f.text, f.fault, f.t, CASE WHEN f.fault='t' THEN 3 ELSE 0 END AS more, [3,3,4,3] AS n, ['user','user','assistant','user'] AS r, {_INSERTED.format("w.z")} AS b FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k=w.k-1)),
e AS (SELECT conv_id, {_INSERTED.format("z")}[1] AS best FROM w WHERE k=1),
s AS (SELECT conv_id, coalesce(max(turn)-min(turn)+1-count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault='b') AS blank, count(*) FILTER (WHERE fault='d') AS duplicate, count(*) FILTER (WHERE fault='t') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.l, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op8_arc_to_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), d AS (SELECT page_id, t, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id=top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id<top THEN top END AS refers_to FROM d""",
}
