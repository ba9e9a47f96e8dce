"""The registered queries of this subpackage, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaccord.llm import conversations, decontamination, language_model, licenses, neardup, packing, quality_lm, quality_rules, secrets, substrings, toxicity, vector_codes, warc
from lakeaccord.llm.components import stored
from lakeaccord.session import fresh_path


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.near_duplicates(spark, _documents(spark, folder))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


NEAR_COPIES = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
shingles as (
  select distinct doc_id, array_to_string(ws[i:least(i + 4, len(ws))], ' ') as s
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from words where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as hits from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by all)
  join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * hits >= 75 * (p.n + q.n - hits)),
edges as (select a, b from links union all select b, a from links),
reach as (select a as node, a as other from edges union select r.node, e.b from reach r join edges e on e.a = r.other),
comp as (select node, min(other) as component_id from reach group by node)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id, d.doc_id = coalesce(c.component_id, d.doc_id) as kept
from documents d left join sizes s using (doc_id) left join comp c on c.node = d.doc_id
"""


def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeated_passages(spark, _documents(spark, folder))


REPEATED_PASSAGES = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as (
  select doc_id, i, array_to_string(ws[i:i + 19], ' ') as s
  from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from words where len(ws) >= 20)),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as r from windows) where r > 1),
gone as (select distinct doc_id, i + j as k from late, range(0, 20) t(j)),
places as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as k from words),
kept as (
  select e.doc_id, count(g.k) as n_removed, string_agg(e.w, ' ' order by e.k) filter (where g.k is null) as t
  from places e left join gone g on g.doc_id = e.doc_id and g.k = e.k group by e.doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(k.n_removed, 0) as bigint) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from words w left join kept k using (doc_id)
"""


def web_archives(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    warc.write_archives(spark.read.parquet(f"{folder}/pages.parquet"), path)
    found = stored(spark, warc.read_archives(spark, path), "records")
    digest = F.col("sha1").alias("payload_digest")
    responses = found.where("type = 'response'")
    original = responses.select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to"), "payload_bytes", digest).dropDuplicates(["of"])
    revisits = found.where("type = 'revisit'").select("page_id", F.col("refers_to").alias("of")).join(original, "of", "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    plain = responses.select("page_id", "payload_bytes", digest, F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    return plain.select(*names).union(revisits.withColumn("record_type", F.lit("revisit")).select(*names))


WEB_ARCHIVES = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select *, max(page_id) over (partition by html) as first_id from p)
select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest,
  case when strlen(html) >= 1000 and page_id < first_id then 'revisit' else 'response' end as record_type,
  case when strlen(html) >= 1000 and page_id < first_id then first_id end as refers_to
from q
"""


def token_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(spark, _documents(spark, folder), tokenizer_path())


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(_documents(spark, folder))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def license_labels(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(_documents(spark, folder))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def text_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_lm.quality(spark, _documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(spark, _documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def adaptive_rules(spark: SparkSession, folder: str) -> DataFrame:
    measured = stored(spark, quality_rules.measure(_documents(spark, folder)), "measures")
    return quality_rules.apply(measured).drop("lang", "source")


def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    hurt = conversations.damage(rows)
    found = conversations.digests(hurt, conversations.audits(hurt)).withColumnRenamed("conv_id", "of")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    zeros = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})


def _conversation_repair_sql() -> str:
    """The grammar's four states walked turn by turn, each with its cheapest edits: another way than the operator's table."""
    kind = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    some = lambda x, cost, edit, line: f"case when {x} is not null then {{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 't': coalesce({x}.t || chr(10), '') || {line}}}::{kind} end"
    drop = lambda x: f"case when {x} is not null then {{'c': {x}.c + 4, 'a': {x}.a || 'D', 't': {x}.t}}::{kind} end"
    keep = lambda x, role: f"case when not forced and initial = '{role}' then {some(x, 'more', 'K', "role || ':' || text")} end"
    turn = lambda x, role: f"case when not forced then {some(x, '(3 + more)', 'R', f'{chr(39)}{role}:{chr(39)} || text')} end"
    filled = lambda cte: f"""{cte}_u as (select *, least(su, {", ".join(some(x, 3, "I", "'user:'") for x in ("s0", "ss", "sa"))}) as iu from {cte}),
{cte}_i as (select *, least(sa, {some("iu", 3, "I", "'assistant:'")}) as ia from {cte}_u)"""  # noqa: E731
    to_user = ", ".join(f(x, r) for x in ("w.s0", "w.ss", "w.ia") for f, r in ((keep, "u"), (turn, "user")))
    return rf"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
said as (
  select dense_rank() over (order by conv_id nulls first) as g, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::BIGINT) as points
  from conversations),
kinds as (select g, conv_id, turn, role, text, xor(list_reduce(points, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 as kind from said, crc),
hurt as (
  select g, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy from kinds),
placed as (select *, row_number() over (partition by g order by turn nulls first, sha256(length(role) || ':' || role || text)) as i from hurt),
judged as (
  select *, case when not regexp_matches(text, '[^ 	-
]') then 'blank' when row_number() over (partition by g, role, text order by i) > 1 then 'duplicate'
    when regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(role) over (partition by g order by i) as before from placed),
turns as (
  select g, i, turn, role, text, fault, before, role[1] as initial, fault in ('blank', 'duplicate') as forced, case when fault = 'truncated' then 3 else 0 end as more from judged),
figures as (
  select g, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (i > 1 and before[1] || initial not in ('su', 'ua', 'au')) as illegal, max(i) as n from turns group by g),
start as (select distinct g, 0::BIGINT as i, {{'c': 0, 'a': '', 't': NULL}}::{kind} as s0, NULL::{kind} as ss, NULL::{kind} as su, NULL::{kind} as sa from said),
walk as (
  select * from start
  union all
  (with {filled("walk")}
  select w.g, r.i, {drop("w.s0")}, least({drop("w.ss")}, {keep("w.s0", "s")}), least({drop("w.iu")}, {to_user}), least({drop("w.ia")}, {keep("w.iu", "a")}, {turn("w.iu", "assistant")})
  from walk_i w join turns r on r.g = w.g and r.i = w.i + 1)),
{filled("walk")},
best as (select g, i, least(s0, ia) as b from walk_i)
select distinct s.conv_id, coalesce(f.gaps, 0)::BIGINT as gaps, coalesce(f.blank, 0) as blank, coalesce(f.duplicate, 0) as duplicate, coalesce(f.truncated, 0) as truncated, coalesce(f.illegal, 0) as illegal,
  b.b.c as cost, b.b.a as audit, sha256(coalesce(b.b.t, '')) as repaired_sha256
from said s left join figures f using (g) join best b on b.g = s.g and b.i = coalesce(f.n, 0)
"""


def vector_compression(spark: SparkSession, folder: str) -> DataFrame:
    found, books, _ = vector_codes.compress(spark, spark.read.parquet(f"{folder}/embeddings.parquet"))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def _vector_compression_sql() -> str:
    """Every part against every entry, round by round."""
    assign = lambda k: f"""near{k} as (
  select rid, p, arg_min(entry, {{'d': d, 'e': entry}}) as entry, min(d) as d
  from (select a.rid, a.p, b.entry, sum((a.v - b.v) * (a.v - b.v))::BIGINT as d from parts a join book{k} b on a.p = b.p and a.pos = b.pos group by all) group by all)"""  # noqa: E731
    rounds = ",\n".join(
        f"""{assign(k)},
book{k + 1} as (
  select b.p, b.entry, b.pos, coalesce(m.v, b.v) as v from book{k} b
  left join (select n.p, n.entry, a.pos, floor(sum(a.v)::DOUBLE / count(*))::BIGINT as v from near{k} n join parts a on a.rid = n.rid and a.p = n.p group by all) m using (p, entry, pos))"""
        for k in range(vector_codes.ROUNDS)
    )
    last = vector_codes.ROUNDS
    return f"""
with kept as (
  select row_number() over (order by vec_id nulls last, embedding) as rid, vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select rid, k // (len(v) // 4) as p, k % (len(v) // 4) as pos, v[k + 1] as v from (select rid, v, unnest(range(len(v))) as k from kept)),
book0 as (select p, rid - 1 as entry, pos, v from parts where rid <= {vector_codes.ENTRIES}),
{rounds},
{assign(last)},
codes as (select rid, string_agg(lower(printf('%02x', entry)), '' order by p) as code, sum(d)::BIGINT as error from near{last} group by rid),
digest as (select sha256(string_agg(v::VARCHAR, ',' order by p, entry, pos)) as sha from book{last})
select vec_id, code, error, (sum(error) over (partition by label))::BIGINT as label_error, sha as codebooks_sha256 from kept join codes using (rid), digest
"""


def text_scores(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score(spark, _documents(spark, folder))


QUERIES = {
    "op5_text_quality": (text_quality, None),
    "op7_benchmark_leaks": (benchmark_leaks, None),
    "op8_adaptive_rules": (adaptive_rules, None),
    "op1_secret_spans": (secret_spans, None),
    "op6_license_labels": (license_labels, None),
    "op9_toxic_documents": (toxic_documents, None),
    "op2_web_archives": (web_archives, WEB_ARCHIVES),
    "op4_token_sequences": (token_sequences, None),
    "op3_near_copies": (near_copies, NEAR_COPIES),
    "op10_repeated_passages": (repeated_passages, REPEATED_PASSAGES),
    "op12_text_scores": (text_scores, None),
    "op13_vector_codes": (vector_compression, _vector_compression_sql()),
    "op11_conversation_repair": (conversation_repair, _conversation_repair_sql()),
}
