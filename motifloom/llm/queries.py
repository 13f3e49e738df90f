"""The registered queries of this subpackage: thin readers of operator outputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm import audit, bpe, chat, decontaminate, digests, lines, secrets, simhash, suffixes, timeparts, toxicity, urls, windows
from motifloom.session import let_workers_import, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = simhash.SimHash(shingle=4, bits=64, radius=4, blocks=6, match=2, repeats=True)
    out = simhash.near_groups(table(spark, sf_dir, "documents"), spec)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffixes.dedup_substrings(docs, length=400, keep="none")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.dedup_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), size=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = said.union(extra).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    out = chat.format_chat(rows).withColumns(
        {"turns": chat.read_turns(F.col("formatted")), "learned": chat.read_loss(F.col("formatted"), F.col("spans"))}
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


URL_RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op10_document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.edit_study(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def tokenizer() -> tuple[str, str]:
    """Path and pattern of the public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, *tokenizer(), digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a repository of its own, its source the owner."""
    out = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def of_kind(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    base = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    more = [(F.size("spans") - F.size("base")).cast("long").alias("n_owned"), F.size("live").cast("long").alias("n_live"), F.size("examples").cast("long").alias("n_examples")]
    return out.select(F.col("id").alias("doc_id"), *base, F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"), *more)


def click_moment() -> Column:
    """``ts`` in microseconds; some rows are moved far back, some to the Monday before."""
    at, day = timeparts.micros(F.col("ts")), timeparts.DAY
    k = F.crc32(F.col("click_id").cast("string")) % 128
    days = (k + 6) * (k + 6) * (k + 6)
    monday = at - F.pmod(at + 3 * day, F.lit(7 * day))
    return F.when(k < 16, at - days * day).when(k > 111, monday).otherwise(at)


def op12_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks")
    limit = 1 + clicks.count() // 650
    folder = f"{shared_dir(spark)}/motifloom-clicks-{uuid.uuid4().hex}"
    order = timeparts.Order(click_moment(), timeparts.micros(F.col("arrived_at")), F.col("click_id"))
    early = F.coalesce(F.col("arrived_at") < F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"), F.lit(False))
    timeparts.update(clicks.where(early), folder, order, limit)
    files = timeparts.update(clicks.where(~early), folder, order, limit)
    found = timeparts.contents(spark, folder, clicks.schema, "click_id").withColumnRenamed("sha256", "ids_sha256")
    out = found.join(F.broadcast(files.drop("n_rows")), ["leaf", "part"])
    columns = F.lit(",".join(clicks.columns)).alias("columns")
    return out.select("leaf", F.col("part").cast("long").alias("part"), columns, "n_rows", "n_new", "rewritten", "ids_sha256", "path")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_document_fingerprint": op10_document_fingerprint,
    "op11_secret_scan": op11_secret_scan,
    "op12_time_partitions": op12_time_partitions,
    "op13_filter_audit": op13_filter_audit,
}

_OP2 = """
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(role) + length(text) + EXTRA)::bigint as formatted_chars
from said group by conv_id
"""

def _count(column: str, found: str) -> str:
    quoted = found.replace("'", "''")
    return f"(length({column}) - length(replace({column}, '{quoted}', ''))) // {len(found)}"


_MARKS = len(chat.TURN + chat.BODY + chat.END)
_EXTRA = " + ".join(
    [str(_MARKS)] + [_count(c, "\\") for c in ("role", "text")] + [f"2 * ({_count(c, s)})" for c in ("role", "text") for s in chat.CONTROL]
)
_OP2 = _OP2.replace("EXTRA", _EXTRA)

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

_OP4 = f"""
with doc as (
  select row_number() over () as rid, doc_id, {_WORDS} as w from documents
), item as (
  select item_id, {_WORDS} as w from benchmark
), phrase as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as p
  from (select item_id, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from item where len(w) > 0)
), size as (
  select distinct n from phrase
), place as (
  select rid, w, unnest(range(1, len(w) + 1)) as i from doc
), found as (
  select rid, i, n, item_id from (select rid, i, n, array_to_string(w[i:i + n - 1], ' ') as p from place, size where i + n - 1 <= len(w)) join phrase using (n, p)
), hit as (
  select rid, count(distinct pos) as n_hit from (select rid, unnest(range(i, i + n)) as pos from found) group by rid
), named as (
  select rid, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct rid, item_id from found) group by rid
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit using (rid) left join named using (rid)
"""

_OP6 = """
with parts as (
  select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), named as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
), rules(verdict, rhost, rpath) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best as (
  select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(verdict, length(rhost || rpath)) as verdict
  from named join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from named left join best using (page_id)
"""

def _op1(tree: lines.Tree) -> str:
    """Lines, their templates level by level, and what stays."""
    looked = [f"k[({i} * n) // least({tree.probes}, n) + 1]" for i in range(tree.probes)]
    agreed = " + ".join(f"coalesce((n > {i} and min({x}) = max({x}))::int, 0)" for i, x in enumerate(looked))
    sql = f"""
with line as materialized (
  select doc_id, i as line_no, ls[i] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null))
), token as (
  select doc_id, line_no, regexp_extract_all(line, '[^ \\x09-\\x0D]+') as words from line
), parsed as materialized (
  select *, len(k) as n from (
    select doc_id, line_no, list_transform(words, lambda t: case when regexp_matches(t, '[0-9]') then chr(1) else t end) as k
    from token where strlen(array_to_string(words, '')) >= {tree.min_bytes})
), exact as (
  select k, min((doc_id, line_no)) as place from parsed group by k having count(distinct doc_id) >= {tree.same_docs}
), rest0 as (
  select doc_id, line_no, n, k, to_json({{'n': n, 'lead': k[1:{tree.depth}]}})::varchar as node from parsed
)"""
    for level in range(tree.splits + 1):
        sql += f""", member{level} as materialized (
  select * from rest{level} where node in (select node from rest{level} group by node having count(*) >= {tree.min_docs} and count(distinct k) > 1)
), place{level} as materialized (
  select doc_id, line_no, node, n, unnest(range(1, n + 1)) as i, unnest(k) as t from member{level}
), constant{level} as (
  select node, i, arg_max(t, c) as t from (select node, i, t, count(*) as c from place{level} group by node, i, t) group by node, i having max(c) * 2 > sum(c)
), close{level} as materialized (
  select p.doc_id, p.line_no, p.node from place{level} p join constant{level} c using (node, i, t)
  group by p.doc_id, p.line_no, p.node, p.n having count(*) >= p.n * {tree.similarity}::double
), template{level} as materialized (
  select node, min((doc_id, line_no)) as place from close{level} group by node having count(distinct doc_id) >= {tree.min_docs}
), left{level} as materialized (
  select doc_id, line_no, n, k, node from member{level} anti join (select doc_id, line_no from close{level} semi join template{level} using (node)) using (doc_id, line_no)
), spot{level} as materialized (
  select l.doc_id, l.line_no, l.n, l.k, l.node, s.total, unnest(range(1, n + 1)) as i, unnest(k) as t
  from left{level} l join (select node, count(*) as total from left{level} group by node having count(*) >= {tree.min_docs} and count(distinct k) > 1) s using (node)
), agreed{level} as materialized (
  select node, i, t, c, agreed >= least({tree.probes}, n) * {tree.similarity}::double as fits, agreed
  from (select node, i, t, n, count(*) as c, total, {agreed} as agreed from spot{level} group by node, i, t, n, total having count(*) >= {tree.min_docs} and count(*) < total)
), pick{level} as materialized (
  select doc_id, line_no, max((fits::int, case when fits then c else agreed end, -i)) as p from spot{level} join agreed{level} using (node, i, t) group by doc_id, line_no
), rest{level + 1} as materialized (
  select doc_id, line_no, n, k, node || to_json({{'at': -p[3], 'token': k[-p[3]]}})::varchar as node from left{level} join pick{level} using (doc_id, line_no)
)"""
    dropped = " union ".join(f"select doc_id, line_no from close{i} join template{i} using (node) where (doc_id, line_no) <> place" for i in range(tree.splits + 1))
    return f"""{sql}, dropped as (
  select doc_id, line_no from parsed join exact using (k) where (doc_id, line_no) <> place union {dropped}
), kept as (
  select doc_id, string_agg(line, chr(10) order by line_no) as text from line anti join dropped using (doc_id, line_no) group by doc_id
), gone as (
  select doc_id, count(*) as n from dropped group by doc_id
)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(gone.n, 0) as n_dropped,
  case when d.text is not null then sha256(coalesce(kept.text, '')) end as kept_sha256
from documents d left join kept using (doc_id) left join gone using (doc_id)
"""


_OP1 = _op1(lines.Tree())

_OP3 = """
with raw as (
  select doc_id, encode(coalesce(text, '')) as b from documents
), start as (
  select doc_id, i, md5(b[i:i + 399]) as h from (select doc_id, b, unnest(range(1, octet_length(b) - 398)) as i from raw where octet_length(b) >= 400)
), often as (
  select h from start group by h having count(*) > 1
), hit as (
  select doc_id, i, lag(i) over (partition by doc_id order by i) as before from start where h in (select h from often)
), piece as (
  select doc_id, i, sum(case when before is null or i > before + 400 then 1 else 0 end) over (partition by doc_id order by i) as run from hit
), span as (
  select doc_id, run, min(i) as b, max(i) + 400 as e from piece group by doc_id, run
), gap as (
  select doc_id, coalesce(lag(e) over w, 1) as b, b as e from span window w as (partition by doc_id order by b)
  union all select doc_id, max(e), null from span group by doc_id
), kept as (
  select doc_id, string_agg(hex(case when gap.e is null then raw.b[gap.b:] else raw.b[gap.b:gap.e - 1] end), '' order by gap.b) as k from gap join raw using (doc_id) where gap.e is null or gap.e > gap.b group by doc_id
), sums as (
  select doc_id, sum(e - b) as n, count(*) as c from span group by doc_id
)
select doc_id, octet_length(raw.b)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(c, 0)::bigint as n_spans,
  sha256(case when c is null then raw.b else unhex(coalesce(k, '')) end) as kept_sha256
from raw left join sums using (doc_id) left join kept using (doc_id)
"""

_OP7 = """
with doc as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') as w from documents
), win as (
  select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from doc where len(w) >= 50)
), first as (
  select h, min(doc_id) as f from win group by h
), hit as (
  select distinct doc_id, unnest(range(i, i + 50)) as i from win join first using (h) where f < doc_id
), word as (
  select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as t from doc
), kept as (
  select doc_id, string_agg(t, ' ' order by i) as k from word anti join hit using (doc_id, i) group by doc_id
), gone as (
  select doc_id, count(*) as n from hit group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256
from doc left join gone using (doc_id) left join kept using (doc_id)
"""

def _spans(kind: int, pattern: str, group: int = 0) -> str:
    """Places of the matches: running sums of the lengths of the matches and of what lies between."""
    found = f"regexp_extract_all(text, {pattern}, {group})" if group else "ms"
    return f"""
  select rid, {kind} as kind, ends[i] - length(ms[i]) as s, ends[i] as e, vs[i] as v from (
    select rid, ms, vs, ends, unnest(range(1, len(ms) + 1)) as i from (
      select rid, ms, {found} as vs, list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(ms[1:i], lambda m: length(m)))) as ends from (
        select rid, text, regexp_extract_all(text, {pattern}) as ms, string_split_regex(text, {pattern}) as gaps from doc where regexp_matches(text, {pattern}))))"""


_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"""'({_NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""

_OP11 = f"""
with doc as materialized (
  select row_number() over () as rid, doc_id, coalesce(source, '') as owner, coalesce(text, '') as text from documents
), base as materialized (
  select * from ({_spans(0, _ASSIGN, 2)}) where length(v) >= 6 union all {_spans(1, "'AKIA[A-Z0-9]{16,}'")} union all {_spans(2, "'[0-9a-f]{24,}'")}
), other as materialized (
  select * from ({_spans(3, "'[A-Za-z0-9+/_=-]{20,}'")}) where length(regexp_replace(v, '[^0-9]', '', 'g')) >= 4
    and length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 4 and len(list_distinct(string_split(v, ''))) >= 8 and not regexp_matches(v, '{secrets.PLACEHOLDER}')
), place as (
  select * from base union all select * from other
), owned as (
  select v, count(distinct owner) as n from place join doc using (rid) group by v
), added as (
  select * from other semi join (select v from owned where n <= 1) using (v)
  where not exists (select 1 from base b where b.rid = other.rid and b.s < other.e and other.s < b.e)
), line as (
  select *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e as t from (select * from base union all select * from added)
), told as (
  select rid, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, count(*) filter (kind = 3) as n_owned,
    string_agg(t, ',' order by s, kind) filter (kind < 3) as base, string_agg(t, ',' order by s, kind) as spans from line group by rid
), copied as (
  select rid, count(*) filter (n >= 3) as n_examples, count(*) filter (n <= 1) as n_live from base join owned using (v) group by rid
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_owned, 0)::bigint as n_owned,
  coalesce(n_live, 0)::bigint as n_live, coalesce(n_examples, 0)::bigint as n_examples
from doc left join told using (rid) left join copied using (rid)
"""

_OP13 = """
with word as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') as w from documents
), first as (
  select text, min(doc_id) as least from word group by text
), known as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id
), doc as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > least, false)::int as m
  from word join first using (text) left join known using (doc_id)
), cell as (
  select part, m, count(*) as n, sum(good) as g, sum(toxic) as t from doc group by part, m
), letter(c, b) as (
  values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), perm as (
  select a.c || b.c || c.c || d.c || e.c as filter_order, [a.b, b.b, c.b, d.b, e.b] as bs
  from letter a, letter b, letter c, letter d, letter e
  where a.b + b.b + c.b + d.b + e.b = 31 and len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5
), step as (
  select filter_order, i::int as step, bs[i] as bit, coalesce(list_sum(bs[1:i - 1]), 0)::int as before from perm, range(1, 6) r(i)
), line as (
  select part, filter_order, step,
    sum(case when m & (before | bit) = 0 then n else 0 end) as kept,
    sum(case when m & before = 0 and m & bit <> 0 then n else 0 end) as removed,
    sum(case when m & before <> 0 and m & bit <> 0 then n else 0 end) as redundant,
    sum(case when m = bit then n else 0 end) as unique_fails,
    sum(case when m & before = 0 and m & bit <> 0 then g else 0 end) as good_lost,
    sum(case when m & before = 0 and m & bit <> 0 then t else 0 end) as toxic_lost
  from cell, step group by part, filter_order, step
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  sum(removed) over (partition by part, filter_order[step])::bigint as shapley
from line
"""

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": _OP1,
    "op2_chat_format": _OP2,
    "op3_suffix_dedup": _OP3,
    "op4_benchmark_decontamination": _OP4,
    "op6_url_filter": _OP6,
    "op7_substring_dedup": _OP7,
    "op11_secret_scan": _OP11,
    "op13_filter_audit": _OP13,
}
