"""All queries of the engine's own operators over the driver's tables, and the same in DuckDB's SQL.

The tables hold no audit log, so events stand for tool calls: user_id is the session, event_type the tool, props.k
an argument, value the tokens spent; odd event ids are results of the call before.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.functions import detect, patterns, scoring
from veilspark.operators import agent, audit, dataset, gates, policy, rating, rpc, scan, skills, tools
from veilspark.streaming import jobs

RULES = (
    policy.Rule("escalate-large-purchase", "escalate", "purchase", token_spent_gt=60, reason="large"),
    policy.Rule("deny-errors", "deny", "^err", reason="error"),
    policy.Rule("deny-nines", "deny", args={"k": "^9"}, any_tool=True, reason="nine"),
)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("call_id"), "ts", F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("tool_name"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("arguments"), F.col("value").alias("token_spent"), F.array().cast("array<string>").alias("call_chain"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = policy.decide(calls(spark, sf_dir), RULES)
    return d.withColumns({"phase": F.when(F.col("call_id") % 5 == 0, "after_call").otherwise("before_call"), "pii_count": F.when(F.col("call_id") % 10 == 0, F.col("arguments")["k"].cast("int") % 3), "timestamp": F.col("ts").cast("string")})


C = "select event_id as call_id, ts, cast(user_id as varchar) as session_id, event_type as tool_name, json_extract_string(props, '$.k') as k, value as token_spent from events"
D = f"select *, case when regexp_matches(tool_name, 'purchase') and token_spent > 60 then 'escalate' when regexp_matches(tool_name, '^err') then 'deny' when regexp_matches(coalesce(k, ''), '^9') then 'deny' else 'allow' end as decision, case when regexp_matches(tool_name, 'purchase') and token_spent > 60 then 'escalate-large-purchase' when regexp_matches(tool_name, '^err') then 'deny-errors' when regexp_matches(coalesce(k, ''), '^9') then 'deny-nines' end as policy_matched from ({C})"
L = f"select *, case when call_id % 5 = 0 then 'after_call' else 'before_call' end as phase, case when call_id % 10 = 0 then cast(k as int) % 3 end as pii_count from ({D})"


@query(f"select call_id, decision, policy_matched from ({D})")
def guard_decisions(spark, d):
    return policy.decide(calls(spark, d), RULES).select("call_id", "decision", "policy_matched")


@query(f"select call_id, case when decision = 'deny' then 'allow' else decision end as decision, decision = 'deny' as would_deny, case when decision = 'deny' then '[dry-run] ' else '' end || case policy_matched when 'escalate-large-purchase' then 'large' when 'deny-errors' then 'error' when 'deny-nines' then 'nine' else '' end as reason from ({D})")
def guard_dry_run(spark, d):
    return policy.decide(calls(spark, d), RULES, dry_run=True).select("call_id", "decision", "would_deny", "reason")


@query("with r as (select * from (values (1, 'views', 'allow', 'view'), (2, 'errors', 'deny', '^err'), (3, 'any', 'escalate', 'e')) r(o, name, action, p)), m as (select e.event_id, r.*, row_number() over (partition by e.event_id order by o) as n from events e join r on regexp_matches(e.event_type, r.p)) select e.event_id as call_id, coalesce(m.action, 'allow') as decision, m.name as policy_matched from events e left join m on m.event_id = e.event_id and m.n = 1")
def guard_rule_table(spark, d):
    rules = spark.createDataFrame([(1, "views", "allow", "view"), (2, "errors", "deny", "^err"), (3, "any", "escalate", "e")], "rule_order int, name string, action string, tool_pattern string")
    return policy.decide_by_table(calls(spark, d), rules).select("call_id", "decision", "policy_matched")


@query(f"select count_if(phase = 'before_call') as total_calls, count_if(phase = 'before_call' and decision = 'allow') as allowed, count_if(phase = 'before_call' and decision = 'deny') as denied, count_if(phase = 'before_call' and decision = 'escalate') as escalated, count_if(phase = 'after_call' and pii_count > 0) as pii_detections from ({L})")
def audit_stats(spark, d):
    return audit.stats(log(spark, d))


@query(f"select tool_name as key, count(*) as n from ({L}) where phase = 'before_call' and decision = 'deny' group by 1 order by n desc, min(call_id) limit 3")
def audit_top_denied(spark, d):
    return audit.top(audit.filtered(log(spark, d), phase="before_call", decision="deny"), "tool_name", 3)


@query(f"select call_id, decision from ({L}) where ts >= (select max(ts) from events) - interval 48 hours and tool_name like '%c%' and decision <> 'allow' and decision = 'deny'")
def audit_filter_last_hours(spark, d):
    last = t(spark, d, "events").agg(F.max("ts").cast("timestamp").alias("as_of"))
    rows = log(spark, d).crossJoin(F.broadcast(last))
    return audit.filtered(rows, as_of=F.col("as_of"), last_hours=48, tool_name="c", decision="deny").select("call_id", "decision")


@query(f"with x as (select session_id, tool_name, count_if(decision = 'deny') as n from ({D}) group by 1, 2), w as (select session_id, tool_name, row_number() over (partition by session_id order by n desc, tool_name) as r from x where n > 0) select d.session_id, count(*) as total_calls, count_if(decision = 'allow') as allow_count, count_if(decision = 'deny') as deny_count, count_if(decision = 'escalate') as escalate_count, count(distinct d.tool_name) as unique_tools, any_value(w.tool_name) as top_denied_tool, min(ts) as started_at, max(ts) as ended_at from ({D}) d left join w on w.session_id = d.session_id and r = 1 group by 1")
def session_summary(spark, d):
    return audit.sessions(policy.decide(calls(spark, d), RULES))


@query(f"select call_id, session_id, cast(row_number() over (partition by session_id order by ts, call_id) as int) as call_index from ({C})")
def call_index(spark, d):
    return audit.numbered(calls(spark, d)).select("call_id", "session_id", "call_index")


@query(f"with n as (select *, row_number() over (partition by session_id order by ts, call_id) as r from ({C})), p as (select session_id, (r + r % 2) // 2 as i, r % 2 as odd, ts from n) select b.session_id, cast(b.i as int) as call_index, (epoch_us(a.ts) - epoch_us(b.ts)) / 1000 as latency_ms from p b join p a on a.session_id = b.session_id and a.i = b.i and b.odd = 1 and a.odd = 0")
def before_after_latency(spark, d):
    n = audit.numbered(calls(spark, d)).withColumn("odd", F.col("call_index") % 2).withColumn("call_index", ((F.col("call_index") + F.col("odd")) / 2).cast("int"))
    return audit.paired(n.where("odd = 1"), n.where("odd = 0"))


@query("select o_custkey, o_orderkey, lag(o_orderkey) over w as prev_scan_id, round_even(s - lag(s) over w, 1) as score_delta from (select *, floor(o_totalprice) / 10 as s from orders) window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def timeline_deltas(spark, d):
    return dataset.timeline(t(spark, d, "orders").withColumn("score", F.floor("o_totalprice") / 10), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", "score")


@query("select case when s >= 9 then 'A' when s >= 7 then 'B' when s >= 5 then 'C' when s >= 3 then 'D' else 'F' end as rating, count(*) as n from (select (o_orderkey * 7 % 100) / 10.0 as s from orders) group by 1")
def rating_distribution(spark, d):
    s = t(spark, d, "orders").select(((F.col("o_orderkey") * 7 % 100) / 10).alias("s"))
    return s.groupBy(scoring.grade(F.col("s")).alias("rating")).agg(F.count("*").alias("n"))


@query("select p_type as category, count(*) as n from part group by 1 order by n desc, category limit 5")
def top_categories(spark, d):
    return t(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(5)


@query("select count(*) as scans, count(distinct o_custkey) as unique_targets, count_if(o_orderstatus = 'F') as passing, count_if(o_orderstatus is not null) as labelled, coalesce(sum(case when o_totalprice > 1e12 then 1 end), 0) as fixed from orders")
def filtered_counts(spark, d):
    return t(spark, d, "orders").agg(F.count("*").alias("scans"), F.countDistinct("o_custkey").alias("unique_targets"), F.count_if(F.col("o_orderstatus") == "F").alias("passing"), F.count_if(F.col("o_orderstatus").isNotNull()).alias("labelled"), F.coalesce(F.sum(F.when(F.col("o_totalprice") > 1e12, 1)), F.lit(0)).alias("fixed"))


@query("select user_id, event_type, arg_max(value, event_id) as status, arg_max(m, event_id) filter (where m is not null) as merged_at, arg_min(value, event_id) as submitted from (select *, case when value > 50 then value end as m from events) group by 1, 2")
def pr_upsert(spark, d):
    v = t(spark, d, "events").select("user_id", "event_type", "event_id", F.col("value").alias("status"), F.when(F.col("value") > 50, F.col("value")).alias("merged_at"), F.col("value").alias("submitted"))
    return dataset.upserted(v, ["user_id", "event_type"], "event_id", ["status"], ["merged_at"], ["submitted"])


@query("select source as pattern_name, count(*) as total_fires, count_if(toxic = 1) as confirmed_true, count_if(toxic = 0) as confirmed_false, count_if(toxic is null) as unreviewed, max(doc_id) as last_fired from documents left join labels using (doc_id) group by 1")
def pattern_effectiveness(spark, d):
    return dataset.effectiveness(t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").select(F.col("source").alias("pattern_name"), (F.col("toxic") == 1).alias("review"), F.col("doc_id").alias("fired_at")))


@query("select count(*) as total, count(quality) as labelled, count_if(quality = (case when n_chars > 300 then 1 else 0 end)) as correct, round_even(count_if(quality = (case when n_chars > 300 then 1 else 0 end)) * 100.0 / count(quality), 1) as accuracy from documents left join labels using (doc_id)")
def calibration_report(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return dataset.calibration(rows.select(F.col("quality").alias("truth"), (F.col("n_chars") > 300).cast("int").alias("predicted")))


@query("select p_partkey, r.low <= p_retailprice and p_retailprice <= r.high as passed from part join (select p_brand, avg(p_retailprice) - 100 as low, avg(p_retailprice) + 100 as high from part group by 1) r using (p_brand)")
def benchmark_check(spark, d):
    p = t(spark, d, "part")
    r = p.groupBy("p_brand").agg((F.avg("p_retailprice") - 100).alias("low"), (F.avg("p_retailprice") + 100).alias("high"))
    return p.join(r, "p_brand").select("p_partkey", F.col("p_retailprice").between(F.col("low"), F.col("high")).alias("passed"))


SEV = "select l_orderkey, count_if(l_returnflag = 'R' and l_linestatus = 'F' and l_quantity > 45) as c, count_if(l_returnflag = 'R') as h, count_if(l_returnflag = 'A') as m, count_if(l_returnflag = 'N') as l, count(*) as n from lineitem group by 1"


def severities(spark, d):
    x = t(spark, d, "lineitem")
    flag = lambda v: F.count_if(F.col("l_returnflag") == v)
    return x.groupBy("l_orderkey").agg(F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45)).alias("c"), flag("R").alias("h"), flag("A").alias("m"), flag("N").alias("l"), F.count("*").alias("n"))


@query(f"select l_orderkey, greatest(0.0, least(10.0, 10.0 - (3 * c + 2 * h + m + 0.25 * l) + least(n / 5.0, 2.0))) as score from ({SEV})")
def severity_penalty_score(spark, d):
    return severities(spark, d).select("l_orderkey", scoring.security_score(*map(F.col, "chml"), scoring.architecture_bonus(F.col("n"))).alias("score"))


@query(f"with s as (select *, greatest(0.0, 10.0 - (3 * c + 2 * h + m + 0.25 * l)) as sec, l_orderkey % 11 * 1.0 as des, l_orderkey % 7 * 1.0 as met, (['MIT', 'AGPL-3.0', 'SSPL-1.0', 'BSD'])[cast(l_orderkey % 4 + 1 as int)] as lic from ({SEV})), o as (select *, round_even(cast(des * 0.35 + sec * 0.35 + met * 0.3 as double), 4) as overall, case when c > 0 then 'critical_vulnerability' when n = 0 then 'no_tools' when lic in ('AGPL-3.0', 'SSPL-1.0') then 'license_banned' end as hard from s) select l_orderkey, overall, hard as hard_constraint, case when hard is null then case when overall >= 9 then 'A' when overall >= 7 then 'B' when overall >= 5 then 'C' when overall >= 3 then 'D' else 'F' end when hard = 'license_banned' and overall >= 4 then 'D' else 'F' end as grade from o")
def composites_and_constraints(spark, d):
    s = severities(spark, d)
    license = F.element_at(F.array(*map(F.lit, ("MIT", "AGPL-3.0", "SSPL-1.0", "BSD"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    s = s.withColumn("overall", scoring.half_even(scoring.weighted({"description": (F.col("l_orderkey") % 11).cast("double"), "security": scoring.security_score(*map(F.col, "chml")), "metadata": (F.col("l_orderkey") % 7).cast("double")}, scoring.LAYER_WEIGHTS), 4)).withColumn("hard_constraint", scoring.hard_constraint(F.col("c"), F.col("n"), license))
    return s.select("l_orderkey", "overall", "hard_constraint", scoring.constrained_grade(F.col("overall"), F.col("hard_constraint")).alias("grade"))


@query("select c_custkey, cast(round_even(least(10.0, greatest(0.0, p * 0.4 + m * 0.35 + s * 0.25)), 2) as double) as score from (select c_custkey, case when c_acctbal >= 9000 then 10.0 when c_acctbal >= 5000 then 7.0 when c_acctbal >= 0 then 4.0 else 1.0 end as p, case when c_nationkey <= 5 then 10.0 when c_nationkey <= 15 then 6.0 else 2.0 end as m, case when c_custkey % 1000 >= 900 then 9.0 when c_custkey % 1000 >= 100 then 5.0 else 2.0 end as s from customer)")
def metadata_score(spark, d):
    p = scoring.step(F.col("c_acctbal"), [(9000, 10.0), (5000, 7.0), (0, 4.0)], 1.0)
    m = scoring.step(-F.col("c_nationkey"), [(-5, 10.0), (-15, 6.0)], 2.0)
    s = scoring.step(F.col("c_custkey") % 1000, [(900, 9.0), (100, 5.0)], 2.0)
    return t(spark, d, "customer").select("c_custkey", scoring.half_even(scoring.weighted({"provenance": p, "maintenance": m, "popularity": s}, scoring.METADATA_WEIGHTS), 2).alias("score"))


PAT = {k: p for k, _, p in detect.PII}


@query(f"select doc_id, len(regexp_extract_all(text, '{PAT['email']}')) as n_email, len(regexp_extract_all(text, '{PAT['phone']}')) as n_phone, len(regexp_extract_all(text, '{PAT['ip_address']}')) as n_ip from documents")
def dlp_counts(spark, d):
    n = lambda k: F.size(F.filter("f", lambda x: x["type"].isin(*k))).cast("long")
    f = t(spark, d, "documents").select("doc_id", detect.findings(F.col("text"), ["email", "phone", "ip_address"]).alias("f"))
    return f.select("doc_id", n(["email"]).alias("n_email"), n(["phone"]).alias("n_phone"), n(["ip_address", "ip_internal"]).alias("n_ip"))


@query(f"with x as (select doc_id, unnest(regexp_extract_all(text, '{PAT['credit_card']}')) as v from documents), y as (select doc_id, list_transform(string_split(reverse(regexp_replace(v, '[^0-9]', '', 'g')), ''), lambda c: cast(c as int)) as g from x) select doc_id, count(*) as cards from y where len(g) >= 13 and list_sum(list_transform(g, lambda c, i: case when i % 2 = 1 then c else (c * 2) % 10 + (c * 2) // 10 end)) % 10 = 0 group by 1")
def dlp_card_luhn(spark, d):
    f = t(spark, d, "documents").select("doc_id", F.explode(detect.findings(F.col("text"), ["credit_card"])))
    return f.groupBy("doc_id").agg(F.count("*").alias("cards"))


@query(f"select doc_id, md5(regexp_replace(text, '{PAT['phone']}', '[REDACTED:phone]', 'g')) as digest from documents")
def dlp_redact_phone(spark, d):
    text = F.col("text")
    return t(spark, d, "documents").select("doc_id", F.md5(detect.redacted(text, detect.without_overlaps(detect.findings(text, ["phone"])))).alias("digest"))


def _acted(spark, d, action):
    # a generator is evaluated once, where a filter on a projected column would repeat the whole detection
    docs = t(spark, d, "documents").select("doc_id", "text", F.explode(F.array(detect.without_overlaps(detect.findings(F.col("text"))))).alias("f"))
    return docs.where(F.size("f") > 0).select("doc_id", F.size("f").alias("findings"), detect.acted(F.col("text"), F.col("f"), action).alias("text"))


@query()
def dlp_redact(spark, d):
    return _acted(spark, d, "redact")


@query()
def dlp_mask(spark, d):
    return _acted(spark, d, "mask")


@query()
def dlp_block(spark, d):
    return _acted(spark, d, "block")


# RE2 has no lookahead: a line holds a credential if it assigns one and names no placeholder after that
CREDENTIAL = "regexp_matches({0}, '(?i)^[^#]*(?:api_key|token|secret|password)\\s*=\\s*[\"''][^\"'']{{8,}}') and not regexp_matches({0}, '(?i)(?:api_key|token|secret|password)\\s*=\\s*[\"''].*(?:example|placeholder|your_|changeme|xxxxxx|<[A-Z_]+>)')"


@query(f"with l as (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as line from documents) select doc_id, cast(line as int) as line, 'hardcoded_credential' as category from l where {CREDENTIAL.format('s')}")
def scan_issue_lines(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return scan.issues(docs, rules=[r for r in scan.RULES if r[0] == "hardcoded_credential"]).select("doc_id", "line", "category").distinct()


TOK = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: length(w) > 2))"


@query(f"with w as (select unnest({TOK.format('text')}) as word from documents), n as (select count(*) as n from documents) select word, count(*) as df from w group by 1 having count(*) > greatest(1, (select n from n) // 2)")
def token_df_stopwords(spark, d):
    return tools.stop_words(t(spark, d, "documents"), "doc_id", "text")


@query(f"with s as (select item_id, {TOK.format('text')} as w from benchmark) select x.item_id as a, y.item_id as b, len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w)) as overlap from s x join s y on x.item_id < y.item_id where len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w)) > 0.12")
def word_overlap(spark, d):
    return tools.overlaps(t(spark, d, "benchmark"), "item_id", "text", 0.12)


FILL = "[" + ", ".join(f"'{w}'" for w in tools.FILLERS) + "]"


@query(f"with w as (select doc_id, text, regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*') as w from documents), s as (select *, list_filter(list_distinct(w), lambda x: length(x) > 1) as u from w), c as (select *, least(len(list_filter(u, lambda x: not list_contains({FILL}, x))) / len(u), len(list_distinct(w)) / len(w)) as s from s) select doc_id, case when len(w) < 3 then 1e0 when len(u) = 0 then 0.3e0 when s >= 0.4 then 1e0 when s >= 0.25 then 0.7e0 else 0.3e0 end as density, case when length(text) < 20 then 0.2e0 when length(text) < 50 then 0.5e0 when length(text) < 80 then 0.7e0 when length(text) <= 500 then 1e0 else 0.7e0 end as length_step, regexp_matches(text, '(?i)fails?\\s+(?:with|if|when|on)|error\\s+(?:if|when|code|message)|(?:if|when)\\s+.*(?:fail|invalid|error|not found)|(?:raise|throw)s?\\s+\\w*(?:Error|Exception)|common\\s+issue|troubleshoot') as has_error_guidance from c")
def description_measures(spark, d):
    text = F.col("text")
    return t(spark, d, "documents").select("doc_id", tools.density(text).alias("density"), tools.length_step(text).alias("length_step"), tools.flags(text)["has_error_guidance"].alias("has_error_guidance"))


@query()
def description_score(spark, d):
    return t(spark, d, "documents").select("doc_id", tools.score(F.col("text")).alias("score"))


@query(f"with b as (select item_id, unnest({TOK.format('text')}) as word from benchmark), i as (select word, ln((select count(*) from benchmark) / (count(*) + 1)) + 1 as idf from b group by 1), q as (select doc_id, unnest({TOK.format('text')}) as word from documents), s as (select doc_id, item_id, round_even(sum(idf), 6) as score from q join b using (word) join i using (word) group by 1, 2), r as (select *, row_number() over (partition by doc_id order by score desc, item_id) as n from s) select doc_id as intent_id, item_id as tool_id, score from r where n = 1")
def intent_rank(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("intent_id"), F.col("text").alias("intent"))
    return tools.ranked(docs, t(spark, d, "benchmark").select(F.col("item_id").alias("tool_id"), F.col("text").alias("description")))


@query("select p_partkey as skill_name, case when p_partkey % 3 = 0 then 'unknown' when p_partkey % 5 = 0 then 'tampered' else 'safe' end as status from part")
def pin_verify(spark, d):
    p = t(spark, d, "part")
    skills = p.select(F.col("p_partkey").alias("skill_name"), F.concat("p_name", F.lit(" \n")).alias("content"))
    pins = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("skill_name"), agent.content_hash(F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name"))).alias("hash"), F.lit(1).alias("pinned_at"))
    return agent.verified(skills, pins)


@query("select distinct s.event_type || e as skill_name, x.target, levenshtein(s.event_type || e, x.target) as distance from (select distinct event_type from events) s, (values ('s'), ('er'), ('ful')) v(e), (values ('view'), ('views'), ('clicks'), ('error')) x(target) where levenshtein(s.event_type || e, x.target) between 1 and 2")
def typosquat(spark, d):
    names = t(spark, d, "events").select("event_type").distinct().select(F.explode(F.array(*[F.concat("event_type", F.lit(e)) for e in ("s", "er", "ful")])).alias("skill_name"))
    return agent.look_alikes(names, spark.createDataFrame([(x,) for x in ("view", "views", "clicks", "error")], "target string")).select("skill_name", "target", F.col("distance").cast("long").alias("distance"))


def _any(phrases):
    return "(" + " or ".join(f"regexp_matches(lower(text), '{x}')" for x, _ in phrases) + ")"


@query(f"select doc_id, {_any(patterns.TEXT_SOURCES)} and {_any(patterns.TEXT_SINKS)} as exfiltration, {_any(patterns.TEXT_SOURCES)} and {_any(patterns.TEXT_DESTRUCTIVE)} as destruction from documents")
def keyword_flows(spark, d):
    f = agent.toxic_flows(t(spark, d, "documents"), "text")
    return f.select("doc_id", F.array_contains("flows", "exfiltration").alias("exfiltration"), F.array_contains("flows", "destructive").alias("destruction"))


@query("select doc_id, case when contains(l, 'mit license') or contains(l, 'permission is hereby granted, free of charge') then 'MIT' when contains(l, 'apache license') and contains(l, 'version 2.0') then 'Apache-2.0' when contains(l, 'bsd') and contains(l, 'redistribution') then 'BSD' when contains(l, 'gpl') or contains(l, 'gnu general public license') then case when contains(l, 'lesser') or contains(l, 'lgpl') then 'LGPL' when contains(l, 'affero') or contains(l, 'agpl') then 'AGPL' else 'GPL' end when contains(l, 'isc license') then 'ISC' when contains(l, 'unlicense') or contains(l, 'public domain') then 'Unlicense' else 'Unknown' end as license from (select doc_id, lower(text) as l from documents)")
def license_classify(spark, d):
    return t(spark, d, "documents").select("doc_id", agent.license_of(F.col("text")).alias("license"))


@query("select n as tool_name, case when regexp_matches(n, '(?:^|[-_])(delete|remove|drop|destroy|purge|clear|reset|revoke|terminate|kill|truncate)(?:[-_]|$)') then 'deny' when c and regexp_matches(n, '(?:^|[-_])(create|update|write|set|put|insert|add|post|send|push|upload|save|modify|edit|patch)(?:[-_]|$)') then 'escalate' when q < 3 then 'escalate' else 'allow' end as action from (select p_partkey, (['get', 'drop', 'update', 'run'])[p_partkey % 4 + 1] || '_' || p_partkey as n, p_partkey % 3 = 0 as c, p_size % 10 as q from part)")
def tool_risk_class(spark, d):
    name = F.concat(F.element_at(F.array(*map(F.lit, ("get", "drop", "update", "run"))), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit("_"), F.col("p_partkey").cast("string"))
    return t(spark, d, "part").select(name.alias("tool_name"), agent.risk_class(name, F.col("p_partkey") % 3 == 0, F.col("p_size") % 10)[1].alias("action"))


@query()
def sarif_export(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("target"), F.col("event_type").alias("rule_id"), F.when(F.col("value") > 80, "critical").otherwise("low").alias("severity"), F.col("props").alias("message"))
    return dataset.sarif_results(e)


@query()
def json_export(spark, d):
    return dataset.export_json({n: t(spark, d, n) for n in ("nation", "region", "supplier")})


@query()
def template_rewrites(spark, d):
    x = t(spark, d, "part").select(F.concat_ws("_", F.lit("get"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))).alias("name"), F.col("p_name").alias("description"))
    return gates.gated_rewrites(skills.rewritten(x).withColumnRenamed("name", "tool_name")).select("tool_name", "description", "rejected", "score")


@query("select 'p' || p_partkey as tool_name, case when p_partkey % 3 = 0 then 'empty suggestion' when p_partkey % 5 = 0 then 'code fix too short' end as rejected from part")
def fix_gate(spark, d):
    k = F.col("p_partkey")
    x = t(spark, d, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("tool_name"), F.lit("truncation").alias("category"), F.lit("").alias("original"), F.when(k % 3 == 0, " ").otherwise("Add a limit to the query").alias("suggestion"), F.when(k % 5 == 0, "x=1").otherwise("rows = cursor.fetchmany(100)").alias("code"))
    return gates.gated_fixes(x).select("tool_name", "rejected")


@query()
def tool_scores(spark, d):
    """A source's documents stand for a server's tools."""
    docs = t(spark, d, "documents").select(F.col("source").alias("server"), F.col("doc_id").alias("tool_name"), F.col("text").alias("description"))
    return tools.scored(docs).select("server", "tool_name", "disambiguation_score", "overall_score")


@query()
def tool_selection(spark, d):
    """Benchmark items stand for tools of one server, conversations for intents."""
    b = t(spark, d, "benchmark").select(F.lit("s").alias("server"), F.concat(F.lit("find_"), F.split("text", " ")[0]).alias("tool_name"), F.col("text").alias("description"), F.col("item_id").alias("position"))
    c = t(spark, d, "conversations").select(F.lit("s").alias("server"), F.concat_ws("-", "conv_id", "turn").alias("intent_id"), F.col("text").alias("intent"))
    return tools.selected(c, b)


@query()
def skill_dimensions(spark, d):
    return t(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in rating.skill_dimensions(F.col("text")).items()])


@query("select c_custkey, least(10e0, 5 + case when c_custkey % 3 > 0 then 2 else 0 end + case when s > 100 then 1 else 0 end) as provenance, least(10e0, case when s >= 5000 then 9.5e0 when s >= 1000 then 8e0 when s >= 500 then 7e0 when s >= 100 then 6e0 when s >= 50 then 5e0 when s >= 10 then 3.5e0 else 2e0 end + case when f >= 100 then 1e0 when f >= 20 then 0.5e0 else 0e0 end) as popularity, case when g < 30 then 9e0 when g < 90 then 7.5e0 when g < 180 then 6e0 when g < 365 then 4e0 else 2e0 end as maintenance from (select c_custkey, cast(abs(c_acctbal) as int) as s, c_custkey % 150 as f, c_custkey % 500 as g from customer)")
def repository_metadata(spark, d):
    k = F.col("c_custkey")
    repos = t(spark, d, "customer").select("c_custkey", F.bround(F.abs("c_acctbal")).cast("int").alias("stars"), (k % 150).alias("forks"), F.date_sub(F.lit("2024-06-01").cast("date"), (k % 500).cast("int")).cast("string").alias("last_commit"), F.lit(None).cast("string").alias("description"), F.when(k % 3 > 0, "MIT").otherwise("NOASSERTION").alias("license"))
    return rating.metadata(repos, F.lit("2024-06-01")).select("c_custkey", "provenance", "popularity", "maintenance")


@query("select event_id, event_type as tool_name, json_extract_string(props, '$.k') as k from events where event_id % 2 = 0")
def rpc_calls(spark, d):
    e = t(spark, d, "events")
    method = F.when(F.col("event_id") % 2 == 0, "tools/call").otherwise("ping")
    line = F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.col("event_id").cast("string"), F.lit(',"method":"'), method, F.lit('","params":{"name":"'), "event_type", F.lit('","arguments":'), "props", F.lit("}}"))
    return rpc.parsed_calls(e.select("event_id", line.alias("line"))).where("tool_name is not null").select("event_id", "tool_name", F.col("arguments")["k"].alias("k"))


@query("select c.name as pattern, c.code, count(*) as n from events join (values ('error', 'typosquat', 'TS-W007'), ('purchase', 'reverse_shell', 'TS-E004'), ('signup', 'gateway.bind', 'TS-C004'), ('click', 'odd', null)) c(type, name, code) on c.type = event_type group by 1, 2")
def issue_codes(spark, d):
    """Findings with their codes, less those ignored, one by code."""
    name = F.col("event_type")
    pattern = F.when(name == "error", "typosquat").when(name == "purchase", "reverse_shell").when(name == "signup", "gateway.bind").when(name == "view", "pin_tampered").otherwise("odd")
    found = agent.coded(t(spark, d, "events").select(pattern.alias("pattern")), "pattern", ["TS-P002", "TS-X999"])
    return found.groupBy("pattern", "code").agg(F.count("*").alias("n"))


@query("select 'events' as name, count(*) as n from events union all select 'orders', count(*) from orders union all select 'part', count(*) from part")
def dataset_totals(spark, d):
    return dataset.totals({n: t(spark, d, n) for n in ("orders", "part", "events")})


@query("with s as (select p_brand as target, max_by(p_size / 5e0, p_partkey) as score from part group by 1) select b.target, s.score, case when b.target like '%1' then s.score >= 3 and s.score <= 10 else s.score >= 0 and s.score <= 8 end as passed from (select distinct p_brand as target from part) b left join s using (target)")
def benchmark_ranges(spark, d):
    p = t(spark, d, "part")
    low = F.col("p_brand").endswith("1")
    b = p.select("p_brand").distinct().select(F.col("p_brand").alias("target"), F.when(low, 3.0).alias("min_score"), F.when(~low, 8.0).alias("max_score"))
    return dataset.benchmarked(b, p.select(F.col("p_brand").alias("target"), (F.col("p_size") / 5).alias("score"), F.col("p_partkey").alias("scan_id"))).select("target", "score", "passed")


@query("select cast(user_id as varchar) as skill_name, max_by(event_type, event_id) as hash from events group by 1 having max_by(event_type, event_id) <> 'view'")
def current_pins(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").cast("string").alias("skill_name"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("hash"), F.col("event_id").alias("pinned_at"))
    return agent.current_pins(e).select("skill_name", "hash")


def _scratch(spark) -> str:
    """A folder below spark.checkpoint.dir. Where that is unset: one of our own in local mode, gone at exit, and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="veilspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared = "file://" + own
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared}/streams/{uuid.uuid4().hex}"


@query(f"select call_id, decision, policy_matched from ({D})")
def stream_guard(spark, d):
    """The decisions of guard_decisions, made by a stream over the same rows."""
    schema, at = t(spark, d, "events").schema, _scratch(spark)
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    c = e.select(F.col("event_id").alias("call_id"), F.col("event_type").alias("tool_name"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("arguments"), F.col("value").alias("token_spent"), F.array().cast("array<string>").alias("call_chain"))
    jobs.run_available(jobs.guard(c, RULES).select("call_id", "decision", "policy_matched"), f"{at}/out", f"{at}/state")
    return spark.read.schema("call_id long, decision string, policy_matched string").parquet(f"{at}/out")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_stats(spark, sf_dir)
