"""Named queries on the work queue: batches, attempts, replies put back, completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.operators import corpus, queue
from papyrine.plans.registry import CARDS, cards, distinct, query
from papyrine.sources.tables import table

_QUEUE = "q as (select distinct reading_id ord, opis_code, delo, path, coalesce(model, '') model, status from transcripts_raw)"


def _queue(spark, sf):
    q = distinct(spark, sf, "transcripts_raw", "reading_id", "opis_code", "delo", "path", "model", "status")
    return q.select(F.col("reading_id").alias("ord"), "opis_code", "delo", "path", F.coalesce("model", F.lit("")).alias("model"), "status")


@query(f"""with {_QUEUE}, p as (select *, row_number() over (partition by model order by ord) - row_number() over (partition by model, opis_code, delo order by ord) island from q where status = 'pending'),
n as (select *, (row_number() over (partition by model, opis_code, delo, island order by ord) - 1) // 4 k from p) select ord, model, min(ord) over (partition by model, opis_code, delo, island, k) batch from n""")
def queue_batches(spark, sf):
    return queue.batches_of_queue(_queue(spark, sf), 4).select("ord", "model", "batch")


@query(f"""with {_QUEUE}, p as (select * from q where status = 'pending'), f as (select * from p order by ord limit 1), m as (select p.*, p.opis_code is not distinct from f.opis_code and p.delo is not distinct from f.delo here from p join f on p.model = f.model)
select ord, path from m where here and ord < coalesce((select min(ord) from m where not here), 9223372036854775807) order by ord limit 4""")
def next_batch(spark, sf):
    return queue.next_batch(_queue(spark, sf), 4).select("ord", "path")


@query("""with l as (select distinct reading_id, path, status, read_at from transcripts_raw where path is not null)
select path, count_if(status <> 'done') attempts, arg_max(status, (read_at, reading_id)) filter (status <> 'done') last_reason, case when count_if(status = 'done') > 0 then 'done' when count_if(status <> 'done') >= 3 then 'refused' else 'failed' end status from l group by 1""")
def try_states(spark, sf):
    """Each scan's tries: failures, the reason of the last one, and the state that follows."""
    log = distinct(spark, sf, "transcripts_raw", "reading_id", "path", "status", "read_at").filter("path is not null").withColumnRenamed("status", "result")
    return queue.states(log, "path", F.struct("read_at", "reading_id"), F.col("result") == "done", "result")


@query(f"with {_QUEUE} select ord, model, title_en reply from q join (select distinct portal_id, title_en from title_en) on portal_id = ord")
def positional_replies(spark, sf):
    """Replies put back to the items whose place is their key."""
    replies = distinct(spark, sf, "title_en", "portal_id", "title_en").select(F.col("portal_id").cast("string").alias("key"), F.col("title_en").alias("reply"))
    return queue.put_back(_queue(spark, sf), replies).select("ord", "model", "reply")


@query(f"with {_QUEUE}, w as (select q.*, case when model = 'typist' then 'typed' else 'hand' end as class from q) select w.class was, coalesce(p.class, w.class) now, count(*) n from w left join (select distinct path, class from page_classes) p using (path) group by 1, 2")
def class_changes(spark, sf):
    """Items by the class that their model stands for and the class that their scan has."""
    was = _queue(spark, sf).withColumn("class", F.when(F.col("model") == "typist", "typed").otherwise("hand"))
    return queue.reclassified(was, distinct(spark, sf, "page_classes", "path", "class")).groupBy(F.col("class").alias("was"), F.col("class_now").alias("now")).agg(F.count("*").alias("n"))


_REPLIES = "x as (select distinct reading_id, reading_id // 4 batch, page || '.jpg' page, path, status, md5(text) body from transcripts_raw where path is not null), g as (select distinct batch, page from x), t as (select batch, path \"name\", reading_id place, body from x where status = 'done' and body is not null)"


@query(f"""with {_REPLIES}, c as (select batch, count(*) parts from t group by 1), d as (select batch, count(*) pages from g group by 1),
f as (select g.batch, g.page, arg_min(body, place) filter (contains("name", g.page)) fit, any_value(body) only_ from g left join t using (batch) group by 1, 2)
select batch, page, coalesce(fit, case when parts = 1 and pages = 1 then only_ end) body from f left join c using (batch) left join d using (batch)""")
def reply_parts(spark, sf):
    """The parts of each reply put to the pages of its batch: by the page's name within the part's, else the only one."""
    x = table(spark, sf, "transcripts_raw", "reading_id", "page", "path", "status", "text").filter("path is not null")
    x = x.select("reading_id", F.floor(F.col("reading_id") / 4).alias("batch"), F.concat("page", F.lit(".jpg")).alias("page"), "path", "status", F.md5("text").alias("body")).distinct()
    parts = x.filter("status = 'done' and body is not null").select("batch", F.col("path").alias("name"), F.col("reading_id").alias("place"), "body")
    return queue.by_name(x.select("batch", "page").distinct(), parts)


@query(f"with {_QUEUE} select opis_code, delo, count(*) items, avg((status = 'done')::int) * 100 percent, min(ord) filter (status = 'pending') as \"next\" from q group by 1, 2")
def completion(spark, sf):
    return queue.completion(_queue(spark, sf), ["opis_code", "delo"], "ord")


@query(f"with {_QUEUE}, j as (select ord // 40 job, list(ord) as keys, case when count_if(status <> 'done') = 0 then 'collected' else 'open' end state from q group by 1), b as (select distinct unnest(keys) ord from j where state <> 'collected') select count(*) busy, (select count(*) from q where status in ('pending', 'failed') and ord not in (select ord from b)) waiting from b")
def busy_items(spark, sf):
    """Items in jobs that are not collected, and waiting items that are in none of these. A job has forty items."""
    q = _queue(spark, sf)
    jobs = q.groupBy(F.floor(F.col("ord") / 40).alias("job")).agg(F.collect_list("ord").alias("keys"), F.when(F.count_if(F.col("status") != "done") == 0, "collected").otherwise("open").alias("state"))
    b = queue.busy(jobs)
    waiting = q.filter("status in ('pending', 'failed')").join(b, "ord", "left_anti").agg(F.count("*").alias("waiting"))
    return b.agg(F.count("*").alias("busy")).join(waiting)  # one row beside one row


@query("select coalesce(model, '') model, count(*) n, count_if(coalesce(trim(text, ' ') <> '', false) and status is distinct from 'refused') usable from (select distinct reading_id, model, status, text from transcripts_raw) group by 1")
def usable_replies(spark, sf):
    """Replies that can be kept: with a text, and not ended by a limit (which the refused ones stand for)."""
    finish = F.when(F.col("status") == "refused", "MAX_TOKENS").otherwise("STOP")
    r = table(spark, sf, "transcripts_raw", "reading_id", "model", "status", "text").select("reading_id", F.coalesce("model", F.lit("")).alias("model"), corpus.usable_reply(F.col("text"), finish).alias("ok")).distinct()
    return r.groupBy("model").agg(F.count("*").alias("n"), F.count_if("ok").alias("usable"))


@query(f"with {CARDS}, n as (select portal_id, status, coalesce(pages, 0) p, greatest(1, coalesce(expected, 0) - coalesce(pages, 0)) need from c) select portal_id, case when status = 'ok' then p else p + least(8, need) end pages, case when status = 'ok' or need <= 8 then 'ok' else 'partial' end status from n")
def passes(spark, sf):
    """Incomplete cards in at most eight passes, of which each gets one page more."""
    todo = cards(spark, sf).select("portal_id", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("expected", F.lit(0)).alias("expected"), "status")

    def attempt(rows):
        more = F.col("pages") + 1
        return rows.select("portal_id", more.alias("pages"), "expected", F.when(more >= F.col("expected"), "ok").otherwise("partial").alias("status"))

    return queue.in_passes(todo, attempt, ["portal_id"]).drop("expected")
