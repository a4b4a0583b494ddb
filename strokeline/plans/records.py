"""Queries of records: customers stand for documents, orders for jobs and revisions, line items for requests, events for logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import control, records
from ..sources.tables import table
from .control import JOBS, LOGS, jobs, logs
from .registry import query

_NOW = "TIMESTAMP '1998-06-01 00:00:00'"


def _now():
    return F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    j = jobs(spark, folder).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    return j.withColumns({"attempt": (F.col("job_id") % 4).cast("int"), "cancel_requested": F.col("job_id") % 7 == 0, "result_id": F.lit(None).cast("string"), "lease_expires_at": F.col("created_at") + F.expr("interval 120 seconds")})


_J = f"(SELECT *, CAST(job_id % 4 AS INTEGER) AS attempt, job_id % 7=0 AS cancel_requested, created_at + INTERVAL 120 SECOND AS lease_expires_at FROM ({JOBS}))"


@query(" UNION ALL ".join(f"SELECT o_orderkey AS id, '{kind}' AS kind, concat({pattern}) AS key FROM orders" for kind, pattern in (
    ("original", "'documents/', o_custkey, '/original'"), ("reading", "'documents/', o_custkey, '/readings/', o_orderkey, '.json'"), ("color_mask", "'documents/', o_custkey, '/masks/color/', o_orderstatus, '.png'"),
    ("stage_artifact", "'jobs/', o_orderkey, '/stages/', o_orderpriority, '/', sha256(CAST(o_orderkey AS VARCHAR))"), ("scene", "'documents/', o_custkey, '/revisions/', o_orderkey, '/scene.json'"), ("export", "'documents/', o_custkey, '/exports/', o_orderkey, '/svg'"))))
def artifact_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of six kinds of artifacts for every order."""
    o = table(spark, folder, "orders")
    parts = {"document_id": F.col("o_custkey"), "job_id": F.col("o_orderkey"), "revision_id": F.col("o_orderkey"), "layer_id": F.col("o_orderstatus"), "stage": F.col("o_orderpriority"), "content_hash": F.sha2(F.col("o_orderkey").cast("string"), 256), "format": F.lit("svg")}
    kinds = ("original", "reading", "color_mask", "stage_artifact", "scene", "export")
    each = F.array(*[F.struct(F.lit(k).alias("kind"), records.artifact_key(k, **parts).alias("key")) for k in kinds])
    return o.select(F.col("o_orderkey").alias("id"), F.explode(each).alias("a")).select("id", "a.kind", "a.key")


@query("""SELECT c_custkey AS document_id, c_name AS name, 'old' AS source FROM customer UNION ALL SELECT s_suppkey, min(s_name), 'new' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer) GROUP BY s_suppkey UNION ALL SELECT p_partkey, p_name, 'new' FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer) AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)""")
def inserted_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents after two inserts that keep existing rows."""
    old = table(spark, folder, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("name"), F.lit("old").alias("source"))
    made = records.inserted(old, table(spark, folder, "supplier").select(F.col("s_suppkey").alias("document_id"), F.col("s_name").alias("name"), F.lit("new").alias("source")), "document_id")
    return records.inserted(made, table(spark, folder, "part").select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("name"), F.lit("new").alias("source")), "document_id")


@query(f"""WITH r AS (SELECT l_orderkey*3 AS job_id, min(l_partkey) AS document_id, min(l_shipdate) AS created_at FROM lineitem GROUP BY 1), n AS (SELECT * FROM r WHERE job_id NOT IN (SELECT job_id FROM ({JOBS})))
SELECT 'job' AS record, state AS what, count(*) AS n, min(job_id) AS first FROM (SELECT job_id, state FROM ({JOBS}) UNION ALL SELECT job_id, 'queued' FROM n) GROUP BY state UNION ALL SELECT 'outbox', 'job.queued', count(*), min(job_id) FROM n""")
def enqueued_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """New jobs and their outbox events, from the same requests."""
    l = table(spark, folder, "lineitem")  # noqa: E741
    requests = l.groupBy((F.col("l_orderkey") * 3).alias("job_id")).agg(F.min("l_partkey").alias("document_id"), F.min("l_shipdate").cast("timestamp_ntz").alias("created_at"))
    after, outbox = records.enqueued(_jobs(spark, folder).select("job_id", "document_id", "state", "created_at"), requests)
    counted = lambda rows, record, what, key: rows.groupBy(F.lit(record).alias("record"), what.alias("what")).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    return counted(after, "job", F.col("state"), "job_id").union(counted(outbox, "outbox", F.col("kind"), "event_id"))


@query(f"""WITH o AS (SELECT event_id, CASE WHEN event_id % 3=0 THEN ts END AS published_at FROM events), d AS (SELECT DISTINCT o_orderkey AS event_id FROM orders WHERE o_orderstatus='F')
SELECT event_id, coalesce(published_at, CASE WHEN d.event_id IS NOT NULL THEN {_NOW} END) AS published_at FROM o LEFT JOIN d USING (event_id)""")
def published_events(spark: SparkSession, folder: str) -> DataFrame:
    """The outbox after its pending events were marked, twice."""
    outbox = table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp_ntz")).alias("published_at"))
    done = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    once = records.published(outbox, done, _now())
    return records.published(once, done, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")).select("event_id", "published_at")


@query("SELECT user_id AS job_id, arg_min(event_id, ts) AS first_delivery, count(*) AS deliveries FROM events GROUP BY user_id")
def queued_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """The delivery that waits in the queue for each job, and how many there were."""
    e = table(spark, folder, "events").withColumn("deliveries", F.count("*").over(Window.partitionBy("user_id")))
    return records.queue_order(e, "user_id", ["ts", "event_id"]).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("first_delivery"), "deliveries")


@query(f"""WITH l AS (SELECT job_id, max(created_at) AS t FROM ({LOGS}) GROUP BY job_id), n AS (SELECT job_id, state, lease_expires_at, t FROM {_J} LEFT JOIN l USING (job_id))
SELECT job_id, CASE WHEN state='running' AND t IS NOT NULL THEN greatest(lease_expires_at, t + INTERVAL 120 SECOND) ELSE lease_expires_at END AS lease_expires_at FROM n""")
def renewed_leases(spark: SparkSession, folder: str) -> DataFrame:
    """Leases after the logs of running jobs prolonged them."""
    made = records.renewed(_jobs(spark, folder), logs(spark, folder).withColumn("created_at", F.col("created_at").cast("timestamp_ntz")))
    return made.select("job_id", "lease_expires_at")


@query(f"""WITH b AS (SELECT DISTINCT l_orderkey AS job_id FROM lineitem WHERE l_returnflag='R'), c AS (SELECT DISTINCT l_orderkey AS job_id FROM lineitem WHERE l_discount>0.05),
j AS (SELECT j.*, b.job_id IS NOT NULL AS back, c.job_id IS NOT NULL AS ask FROM {_J} j LEFT JOIN b USING (job_id) LEFT JOIN c USING (job_id)), q AS (SELECT *, CASE WHEN back AND state='running' THEN greatest(attempt-1,0) ELSE attempt END AS a, CASE WHEN back AND state='running' THEN 'queued' ELSE state END AS s FROM j)
SELECT job_id, a AS attempt, CASE WHEN ask AND s='queued' THEN 'canceled' ELSE s END AS state, cancel_requested OR (ask AND s IN ('queued','running')) AS cancel_requested FROM q""")
def requeued_and_canceled(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs after some went back to the queue and some were asked to stop."""
    l = table(spark, folder, "lineitem")  # noqa: E741
    back = records.requeued(_jobs(spark, folder), l.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id")))
    made = records.canceled(back, l.where("l_discount > 0.05").select(F.col("l_orderkey").alias("job_id")))
    return made.select("job_id", "attempt", "state", "cancel_requested")


@query(f"""WITH r AS (SELECT l_orderkey AS job_id, min(l_linenumber) AS k FROM lineitem GROUP BY l_orderkey), h AS (SELECT job_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(CAST(job_id AS VARCHAR))) AS h FROM r),
u AS (SELECT job_id, concat(substr(h,1,8),'-',substr(h,9,4),'-5',substr(h,14,3),'-',substr('89ab', CAST(strpos('0123456789abcdef', substr(h,17,1))-1 AS INTEGER) % 4 + 1, 1),substr(h,18,3),'-',substr(h,21,12)) AS uid FROM h)
SELECT j.job_id, CASE WHEN r.job_id IS NOT NULL AND state='running' AND NOT cancel_requested THEN 'succeeded' WHEN r.job_id IS NOT NULL AND state='running' THEN 'canceled' ELSE state END AS state, CASE WHEN r.job_id IS NOT NULL AND state='running' AND NOT cancel_requested THEN CASE WHEN k=1 THEN concat('rev-', CAST(j.job_id AS VARCHAR)) ELSE uid END END AS result_id FROM {_J} j LEFT JOIN r USING (job_id) LEFT JOIN u USING (job_id)""")
def completed_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs after their results came, and came again."""
    l = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.min("l_linenumber").alias("k"))  # noqa: E741
    results = l.select("job_id", F.when(F.col("k") == 1, F.concat(F.lit("rev-"), F.col("job_id").cast("string"))).alias("revision_id"))
    once = records.completed(_jobs(spark, folder), results)
    return records.completed(once, results).select("job_id", "state", "result_id")


@query(f"""SELECT j.job_id, CASE WHEN a.document_id IS NOT NULL AND NOT created_at + INTERVAL 10 MINUTE<{_NOW} THEN 'wait' WHEN a.document_id IS NOT NULL THEN 'give_up' ELSE 'run' END AS verdict FROM {_J} j LEFT JOIN (SELECT DISTINCT l_partkey AS document_id FROM lineitem WHERE l_linestatus='O') a USING (document_id)""")
def waiting_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Reading jobs that wait for an active pipeline job of their document."""
    pipeline = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("document_id"), F.when(F.col("l_linestatus") == "O", "running").otherwise("succeeded").alias("state"))
    return records.waiting(_jobs(spark, folder), pipeline, _now())


@query(f"SELECT o_orderkey AS key, o_orderdate + INTERVAL 300 SECOND AS deadline FROM orders WHERE o_orderdate + INTERVAL 300 SECOND>{_NOW}")
def open_intents(spark: SparkSession, folder: str) -> DataFrame:
    """Publications whose grace period lasts."""
    intents = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    return records.open_intents(intents, _now()).select("key", "deadline")


@query("""SELECT o_orderkey AS request_id, CASE WHEN c_custkey IS NULL THEN 404 WHEN c_nationkey IS DISTINCT FROM o_orderkey % 25 THEN 403 ELSE 200 END AS status FROM orders LEFT JOIN customer ON c_custkey=o_custkey+5""")
def answered_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Lookups by id with the owner's check: found, missing, or another's."""
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").cast("long").alias("owner_id"))
    wanted = table(spark, folder, "orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") + 5).alias("document_id"), (F.col("o_orderkey") % 25).alias("caller"))
    return records.access(rows, wanted).select("request_id", "status")


@query(f"""SELECT job_id, seq, level, message, CAST(floor((row_number() OVER w)*100.0/(count(*) OVER (PARTITION BY job_id))+0.5) AS INTEGER) AS percent FROM ({LOGS}) WINDOW w AS (PARTITION BY job_id ORDER BY created_at, seq)""")
def job_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Logs of every job in order, with the percentage of its phases that are done."""
    w = Window.partitionBy("job_id")
    made = logs(spark, folder).withColumns({"_k": F.row_number().over(w.orderBy("created_at", "seq")) - 1, "_n": F.count("*").over(w)})
    return made.select("job_id", "seq", "level", "message", records.progress(F.col("_k"), F.col("_n")).alias("percent"))


@query("""WITH r AS (SELECT o_orderkey AS revision_id, o_custkey AS document_id FROM orders), k AS (SELECT r.*, unnest(['svg','png']) AS kind FROM r), e AS (SELECT l_orderkey AS revision_id, CASE WHEN l_returnflag='R' THEN 'svg' ELSE 'png' END AS kind, min(l_partkey) AS key FROM lineitem GROUP BY 1, 2), t AS (SELECT s_suppkey AS document_id, s_name AS key FROM supplier)
SELECT k.revision_id, k.kind, coalesce(CAST(e.key AS VARCHAR), t.key) AS key, CASE WHEN e.key IS NOT NULL THEN 'export' WHEN t.key IS NOT NULL THEN 'trace' END AS source FROM k LEFT JOIN e ON e.revision_id=k.revision_id AND e.kind=k.kind LEFT JOIN t ON t.document_id=k.document_id""")
def shown_exports(spark: SparkSession, folder: str) -> DataFrame:
    """What each revision is shown by: its export, or its document's trace."""
    r = table(spark, folder, "orders").select(F.col("o_orderkey").alias("revision_id"), F.col("o_custkey").alias("document_id"), F.explode(F.array(F.lit("svg"), F.lit("png"))).alias("kind"))
    kind = F.when(F.col("l_returnflag") == "R", "svg").otherwise("png")
    e = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("revision_id"), kind.alias("kind")).agg(F.min("l_partkey").cast("string").alias("key"))
    t = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("document_id"), F.col("s_name").alias("key"))
    return records.exports_of(r, e, t)


@query("""WITH r AS (SELECT o_custkey AS document_id, o_orderkey AS revision_id, o_orderdate AS created_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_id FROM orders), i AS (SELECT l_orderkey AS revision_id, count(*) AS items, count(*) FILTER (WHERE l_linestatus='O') AS open FROM lineitem GROUP BY l_orderkey)
SELECT document_id, revision_id, number, parent_id, coalesce(items,0) AS items, coalesce(open,0) AS open FROM r LEFT JOIN i USING (revision_id)""")
def revision_list(spark: SparkSession, folder: str) -> DataFrame:
    """Revisions of every document in order, with the review items of each."""
    w = Window.partitionBy("document_id").orderBy("created_at", "revision_id")
    r = table(spark, folder, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("revision_id"), F.col("o_orderdate").alias("created_at"))
    r = r.withColumns({"number": F.row_number().over(w), "parent_id": F.lag("revision_id").over(w)})
    i = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("revision_id")).agg(F.count("*").alias("items"), F.count_if(F.col("l_linestatus") == "O").alias("open"))
    return r.join(i, "revision_id", "left").fillna(0, ["items", "open"]).select("document_id", "revision_id", "number", "parent_id", "items", "open")


@query("""WITH o AS (SELECT o_custkey AS document_id, max_by(o_orderkey, o_orderdate) AS any_job, count(*) AS jobs FROM orders GROUP BY o_custkey), n AS (SELECT o_custkey AS document_id, arg_max(o_orderstatus, struct_pack(d:=o_orderdate, k:=o_orderkey)) AS state, max(o_orderdate) AS changed FROM orders GROUP BY o_custkey)
SELECT c_custkey AS document_id, c_name AS name, n_name AS owner, coalesce(jobs,0) AS jobs, n.state, n.changed FROM customer JOIN nation ON n_nationkey=c_nationkey LEFT JOIN o ON o.document_id=c_custkey LEFT JOIN n ON n.document_id=c_custkey""")
def document_details(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its owner, number of jobs, and the state and time of the last."""
    newest = control.first_by(table(spark, folder, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("changed"))
    count = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("document_id")).agg(F.count("*").alias("jobs"))
    c = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    made = c.select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("name"), F.col("n_name").alias("owner"))
    return made.join(count, "document_id", "left").join(newest, "document_id", "left").fillna(0, ["jobs"])


@query("""SELECT 'document' AS kind, o_orderkey AS request_id, c_name AS value, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN customer ON c_custkey=o_custkey*2 UNION ALL SELECT 'upload', p_partkey, c_name, c_custkey IS NOT NULL FROM part LEFT JOIN customer ON c_nationkey=p_size AND c_custkey=p_partkey UNION ALL SELECT 'item', p_partkey, l_returnflag, l_orderkey IS NOT NULL FROM part LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber, arg_max(l_returnflag, l_partkey*100000+l_suppkey*100+l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_returnflag FROM lineitem) l ON l_orderkey=p_partkey AND l_linenumber=p_size % 4+1""")
def looked_up_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by id, uploads by owner and key, and review items by revision and number."""
    c, p, l = (table(spark, folder, n) for n in ("customer", "part", "lineitem"))  # noqa: E741
    rows = c.select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("owner"), F.col("c_name").alias("value"))
    documents = records.looked_up(rows, table(spark, folder, "orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") * 2).alias("document_id")), ["document_id"], ["value"])
    uploads = records.looked_up(rows, p.select(F.col("p_partkey").alias("request_id"), F.col("p_size").alias("owner"), F.col("p_partkey").alias("document_id")), ["owner", "document_id"], ["value"])
    flag = F.max_by("l_returnflag", F.col("l_partkey") * 100000 + F.col("l_suppkey") * 100 + F.col("l_quantity"))
    own = l.groupBy(F.col("l_orderkey").alias("revision_id"), F.col("l_linenumber").alias("number")).agg(flag.alias("value"))
    items = records.looked_up(own, p.select(F.col("p_partkey").alias("request_id"), F.col("p_partkey").alias("revision_id"), (F.col("p_size") % 4 + 1).alias("number")), ["revision_id", "number"], ["value"])
    named = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), "request_id", "value", "found")
    return named("document", documents).union(named("upload", uploads)).union(named("item", items))


@query(f"""WITH l AS (SELECT DISTINCT l_orderkey AS job_id FROM lineitem WHERE l_returnflag='R'), j AS (SELECT job_id, attempt, state, CASE WHEN l.job_id IS NOT NULL AND state='running' THEN greatest(attempt-1,0) ELSE attempt END AS a, CASE WHEN l.job_id IS NOT NULL AND state='running' THEN 'queued' ELSE state END AS s FROM {_J} LEFT JOIN l USING (job_id))
SELECT job_id, concat('{{"state":"', state, '","attempt":', attempt, '}}') AS old, concat('{{"state":"', s, '","attempt":', a, '}}') AS new FROM j WHERE state<>s OR attempt<>a""")
def change_events(spark: SparkSession, folder: str) -> DataFrame:
    """What requeueing changed, as events with the old and the new values."""
    before = _jobs(spark, folder)
    after = records.requeued(before, table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id")))
    return records.change_events(before, after, "job_id", ["state", "attempt"])
