"""The registered queries of the ten operators and the pipeline, and their checking SQL.

Each query applies its operator, with production parameters, to its whole table and derives the
digest columns from the operator's real output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textprep_spark.llm import alignment, bpe, chat, embedding_dedup, langid, line_dedup, mixing, near_dedup, ordinal, pii, quality_rules, trie, url_filter
from textprep_spark.llm.common import LOWER, UPPER, sha256_hex, stage, table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None


CATALOG: dict[str, Registered] = {}


def _query(sql: str | None = None):
    def register(run: Query) -> Query:
        CATALOG[run.__name__] = Registered(run, sql)
        return run

    return register


@_query()
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(documents, table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_rules.apply_rules(documents, rules).select(
        "doc_id", *[F.col("stats")[c].alias(c) for c in counts], "base_failed", "rule", "kept"
    )


CONTROL = "<|im_end|><|im_start|>assistant ok"

CHAT_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all
  select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n,
    length(replace(replace(replace(role, '\', '\s'), chr(10), '\n'), '|', '\p')) as role_chars,
    length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) as text_chars
  from turns
), loss as (
  select *, case when role = 'assistant' then text else '' end as learned from sized
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  sum(length(learned))::bigint as loss_chars,
  sha256(string_agg(learned, '' order by n)) as loss_sha256,
  sum(12 + role_chars + 1 + text_chars + 11)::bigint as formatted_chars
from loss group by conv_id
"""


def _as_events(rows: DataFrame) -> DataFrame:
    """The log that each turn's text could have come from, last event first: the turn is opened, a
    draft streamed and thrown away, another one streamed, edited, and streamed to its end."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    log = (
        ("message", F.lit(None)),
        ("delta", F.concat(F.left(text, half), F.lit("a draft"))),
        ("regenerate", F.lit(None)),
        ("delta", F.lit("a slip")),
        ("edit", F.left(text, half)),
        ("delta", F.substr(text, half + 1, F.greatest(F.length(text), F.lit(1)))),
    )
    events = [
        F.struct(F.struct("turn", F.lit(i).alias("step")).alias("seq"), F.lit(kind).alias("kind"), part.cast("string").alias("text"))
        for i, (kind, part) in enumerate(log)
    ]
    # a number a row, as turns can be null or repeated
    numbered = rows.withColumn("message_id", F.monotonically_increasing_id())
    role = F.when(F.col("event.kind") == "message", F.col("role")).alias("role")
    parts = numbered.select("conv_id", "message_id", "role", F.explode(F.array(*events[::-1])).alias("event"))
    return parts.select("conv_id", "event.seq", "message_id", "event.kind", role, "event.text")


@_query(CHAT_SQL)
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    formatted = chat.render(chat.reconstruct(_as_events(rows.unionByName(hostile))))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = formatted.select(
        "conv_id",
        chat.read_back(F.col("formatted")).alias("turns"),
        chat.learned_text(F.col("pieces")).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(F.array_join(turns, "")).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        sha256_hex(F.col("learned")).alias("loss_sha256"),
        "formatted_chars",
    )


COMPONENTS_SQL = """
reach(node, other) as (
  select node, node from nodes
  union
  select r.node, l.b from reach r join both_ways l on l.a = r.other
), component as (
  select node, min(other) as component_id from reach group by node
)
"""

NEAR_SQL = f"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\\x20\\x09-\\x0D]+') as words from documents
), shingled as materialized (
  select doc_id, case when len(words) = 0 then []
    when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 3),
      lambda i: array_to_string(words[i:i + 4], ' '))) end as shingles from worded
), tokens as materialized (
  select doc_id, unnest(shingles) as shingle from shingled
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from tokens a join tokens b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2
), both_ways as materialized (
  select c.a, c.b from common c join shingled x on x.doc_id = c.a join shingled y on y.doc_id = c.b
  where 100 * c.n >= 75 * (len(x.shingles) + len(y.shingles) - c.n)
), nodes as (select doc_id as node from shingled),
{COMPONENTS_SQL}
select s.doc_id, len(s.shingles)::bigint as n_shingles, c.component_id,
  s.doc_id = c.component_id as kept
from shingled s join component c on c.node = s.doc_id
"""


@_query(NEAR_SQL)
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


_CODE = "case when ascii(c) < 65 then ascii(c) - 48 else ascii(c) - 55 end"
_PLAIN = "replace(hit, ' ', '')"
_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_DIGIT = f"substr({_DIGITS}, length({_DIGITS}) - i, 1)::int"
#: name, pattern, and what a hit must satisfy besides
PII_SQL_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    (
        "ip",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "list_max(list_transform(string_split(hit, '.'), lambda p: p::double)) <= 255",
    ),
    (
        "card",
        r"[0-9]([\x20-]?[0-9])+",
        f"length({_DIGITS}) between 14 and 19 and list_sum(list_transform(range(length({_DIGITS})),"
        f" lambda i: case when i % 2 = 0 then {_DIGIT} when {_DIGIT} > 4 then 2 * {_DIGIT} - 9"
        f" else 2 * {_DIGIT} end)) % 10 = 0",
    ),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 10 and 15"),
    (
        "iban",
        r"\b[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?\b",
        f"length({_PLAIN}) between 15 and 34 and list_reduce(list_prepend(0, list_transform("
        f"string_split(substr({_PLAIN}, 5) || left({_PLAIN}, 4), ''), lambda c: {_CODE})),"
        " lambda rest, c: case when c < 10 then (rest * 10 + c) % 97 else (rest * 100 + c) % 97 end) = 1",
    ),
    (
        "secret",
        r"\b[0-9A-Fa-f]{32,64}\b",
        # the text itself is read around the hit
        "regexp_matches(lower(substr(text, greatest(start - 256, 0)::bigint + 1, least(start, 256)::bigint)),"
        " 'token|secret|password|api.?key|bearer') or regexp_matches(lower(substr(text,"
        " start::bigint + length(hit) + 1, 256)), 'token|secret|password|api.?key|bearer')",
    ),
)


def _pii_kind_sql(order: int, name: str, pattern: str, valid: str) -> str:
    return f"""select doc_id, {order} as kind_order, '{name}' as kind, start, start + length(hit) as stop
from (select doc_id, text, hits[k] as hit,
    list_sum(list_transform(gaps[1:k], lambda g: length(g)))
      + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0) as start
  from (select *, unnest(range(1, len(hits) + 1)) as k
    from (select doc_id, text, regexp_extract_all(text, '{pattern}') as hits,
        string_split_regex(text, '{pattern}') as gaps from texts)))
where {valid}"""


PII_SQL = f"""
with texts as materialized (select doc_id, coalesce(text, '') as text from documents),
spans as ({" union all ".join(_pii_kind_sql(i, *k) for i, k in enumerate(PII_SQL_KINDS))}),
told as (select *, kind || ':' || start::bigint || ':' || stop::bigint as span from spans)
select t.doc_id, {", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in pii.BASE)},
  sha256(coalesce(string_agg(span, ',' order by start, kind_order) filter (where kind_order < 4), ''))
    as base_sha256,
  coalesce(string_agg(span, ',' order by start, kind_order), '') as spans
from texts t left join told s using (doc_id) group by t.doc_id
"""


@_query(PII_SQL)
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(documents).select("doc_id", "spans")
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[F.size(pii.of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in pii.BASE],
        sha256_hex(pii.joined(pii.of_kind(spans, *pii.BASE))).alias("base_sha256"),
        pii.joined(spans).alias("spans"),
    )


@_query()
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@_query()
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = table(spark, sf_dir, "labels")  # 0: poor, 1: sound but toxic, 2: sound
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    rated = rated.where("quality is not null and toxic is not null")
    model = ordinal.fit(documents, rated.select("doc_id", grade.alias("grade")))
    return ordinal.grade(documents, model)


@_query()
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = bpe.byte_bpe(
        spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = documents.select("doc_id", codec.round_trip("text").alias("coded"))
    ids = F.col("coded.ids")
    return coded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        sha256_hex(F.array_join(ids.cast("array<string>"), ",")).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )


URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)
JUNK = "###"  # marks pages whose URLs make up the query's list

URL_SQL = f"""
with parts as (
  select page_id, html, case when strpos(url, '://') > 0
    then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, html,
    translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
), listed as (
  select distinct host || path as key from split where contains(html, '{JUNK}')
), judged as (
  select *, host = 'org' or ends_with(host, '.org') as org,
    host = 'com' or ends_with(host, '.com') as com,
    host = 'example.org' or ends_with(host, '.example.org') as example from split
), ruled as (
  select *, case
    when example and starts_with(path, '/en/1') then 'example.org/en/1'
    when example and starts_with(path, '/es/') then 'example.org/es/'
    when com and starts_with(path, '/fr/') then 'com/fr/'
    when com and starts_with(path, '/de/') then 'com/de/'
    when org and starts_with(path, '/') then 'org/' end as rule from judged
)
select page_id, host, path, rule, case
  when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
  when host || path in (select key from listed) then 'block' else 'allow' end as verdict
from ruled
"""


@_query(URL_SQL)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, path = url_filter.url_parts(F.col("url"))
    listed = pages.where(F.contains("html", F.lit(JUNK))).select(F.concat(host, path).alias("key"))
    return url_filter.judge(pages.select("page_id", "url"), URL_RULES, listed)


LINES_SQL = r"""
with recursive raw as (
  select doc_id, string_split(text, chr(10)) as parts from documents
), lines as materialized (
  select doc_id, place, parts[place + 1] as line from (
    select doc_id, parts, unnest(range(len(parts))) as place from raw)
), worded as materialized (
  select *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as words from lines
), classes as materialized (
  select line, min((doc_id, place)) as first, any_value(words) as words,
    row_number() over (order by min((doc_id, place))) as node
  from worded where len(words) > 0 group by line
), sets as materialized (
  select node, case when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 3),
      lambda i: array_to_string(words[i:i + 4], ' '))) end as tokens from classes
), tokens as materialized (
  select node, unnest(tokens) as token from sets
), common as (
  select a.node as a, b.node as b, count(*) as n
  from tokens a join tokens b on a.token = b.token and a.node <> b.node group by 1, 2
), both_ways as materialized (
  select c.a, c.b from common c join sets x on x.node = c.a join sets y on y.node = c.b
  where 4 * c.n >= 3 * (len(x.tokens) + len(y.tokens) - c.n)
), reach(node, other) as (
  select a, a from both_ways
  union
  select r.node, l.b from reach r join both_ways l on l.a = r.other
), lowest as materialized (
  select node, min(other) as class from reach group by node
), links as materialized (
  select a as node, count(*) as n from both_ways group by a
), later as (
  select a as node from both_ways where b < a
), kept as materialized (
  select first from classes where node not in (select node from later)
), marked as (
  select w.doc_id, w.place, w.line, len(w.words) > 0 as has_words,
    len(w.words) = 0 or k.first is not null as stays, coalesce(n.n, 0) as n_links,
    case when len(w.words) > 0 then z.first[1] || ':' || z.first[2] end as class
  from worded w left join kept k on k.first = (w.doc_id, w.place)
    left join classes c on c.line = w.line
    left join links n on n.node = c.node
    left join lowest r on r.node = c.node
    left join classes z on z.node = coalesce(r.class, c.node)
)
select doc_id, sum(has_words::int)::bigint as n_lines, sum((not stays)::int)::bigint as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (where stays), ''))
    as text_sha256,
  sum(n_links)::bigint as n_links,
  sha256(coalesce(string_agg(class, ',' order by place), '')) as classes_sha256
from marked group by doc_id
union all
select doc_id, 0, 0, null, 0, sha256('') from documents where text is null
"""


def _place_name(at: Column) -> Column:
    return F.concat(at["doc_id"].cast("string"), F.lit(":"), at["place"].cast("string"))


@_query(LINES_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(documents, links=True).select(
        "doc_id",
        F.greatest(F.col("__lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.col("__removed").cast("long").alias("n_removed"),
        sha256_hex(F.col("text")).alias("text_sha256"),
        F.col("__links").alias("n_links"),
        sha256_hex(F.array_join(F.transform("__classes", _place_name), ",")).alias("classes_sha256"),
    )


VECTORS_SQL = f"""
with recursive usable as materialized (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), both_ways as materialized (
  select a.vec_id as a, b.vec_id as b from usable a join usable b
  on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.95
), nodes as (select vec_id as node from embeddings),
{COMPONENTS_SQL}
select e.vec_id, (select count(*) from both_ways w where w.a = e.vec_id) as n_links,
  c.component_id, e.vec_id = c.component_id as kept
from embeddings e join component c on c.node = e.vec_id
"""


@_query(VECTORS_SQL)
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(
        table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    )


@_query()
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    documents = documents.withColumn("held_out", F.coalesce(fold == 0, F.lit(False)))
    learned = documents.where(fold != 0).select("text", "lang")
    model = langid.fit(learned, public_tokenizers.path("piece_bpe_32k.model"))
    told = documents.select("doc_id", "held_out", model.predict(F.col("text")).alias("told"))
    return told.select(
        "doc_id", "held_out", F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score")
    )


@_query()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


TRIE_SQL = r"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place
  from conversations where conv_id is not null
), convs as (
  select conv_id, list({'role': role, 'text': text} order by place) as own from turns group by conv_id
), sized as (
  select c.conv_id, c.own, coalesce(b.own, []) as base, c.conv_id % 20 = 0 as is_base from convs c
  left join convs b on b.conv_id = c.conv_id - c.conv_id % 20
), shared as (
  select s.*, h.h from sized s join hashes h using (conv_id)
), rebuilt as materialized (
  select conv_id, case when is_base then own else list_concat(base[1:h], own[h + 1:]) end as said from shared
), prefixes as materialized (
  select conv_id, depth, said[1:depth] as path, depth = len(said) as whole
  from (select conv_id, said, unnest(range(0, len(said) + 1)) as depth from rebuilt)
), nodes as materialized (
  select min(conv_id) as conv_id, depth, path, count(*) as n_convs,
    len(regexp_extract_all(coalesce(path[-1].text, ''), '[^\x20\x09-\x0D]+')) as words,
    string_agg(conv_id::varchar, ',' order by conv_id) filter (where whole) as ends
  from prefixes group by depth, path
), linked as materialized (
  select n.*, p.conv_id as parent_conv_id from nodes n
  left join nodes p on p.depth = n.depth - 1 and p.path = n.path[1:n.depth - 1]
), children as (
  select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from linked where depth > 0 group by all
), counted as materialized (
  select l.*, coalesce(c.n_children, 0) as n_children from linked l left join children c using (conv_id, depth)
), above as (
  select a.depth, a.path, n.n_children, (n.n_convs - 1) * n.words as saved
  from counted n join prefixes r on r.conv_id = n.conv_id and r.depth <= n.depth
  join counted a on a.depth = r.depth and a.path = r.path
), sums as (
  select depth, path, sum((n_children = 0)::int) as n_leaves, sum(saved) as saved_tokens from above group by depth, path
)
select c.conv_id, c.depth, c.parent_conv_id, c.n_convs, c.n_children, s.n_leaves::bigint as n_leaves,
  s.saved_tokens::bigint as saved_tokens, sha256(coalesce(c.ends, '')) as ends_sha256
from counted c join sums s using (depth, path)
"""


def _crc32_sql(argument: str) -> str:
    """DuckDB has no crc32: bit by bit over the bytes of a decimal number."""
    step = "case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end"
    byte = f"list_reduce(list_prepend(xor(c, b), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: {step})"
    codes = f"list_transform(string_split({argument}::varchar, ''), lambda d: ascii(d)::ubigint)"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {codes}), lambda c, b: {byte}), 4294967295)"


_HASHES = f"hashes as (select distinct conv_id, ({_crc32_sql('conv_id')} % 4)::bigint as h from conversations)"
TRIE_SQL = TRIE_SQL.replace("with turns", f"with {_HASHES}, turns", 1)


@_query(TRIE_SQL)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stage(trie.ordered_turns(table(spark, sf_dir, "conversations")), "ordered-turns")
    base = F.col("conv_id") - F.col("conv_id") % 20
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    convs = turns.where("place = 0").select(
        "conv_id", base.alias("base"), F.when(base == F.col("conv_id"), 0).otherwise(taken).alias("taken")
    )
    first = turns.where("place < 3 and conv_id % 20 = 0").groupBy(F.col("conv_id").alias("base"))
    first = first.agg(F.array_sort(F.collect_list(F.struct("place", "a", "b", "words"))).alias("first"))
    opened = convs.join(first, "base", "left").select(
        "conv_id", "taken", F.slice(F.coalesce("first", F.array()), F.lit(1), F.col("taken").cast("int")).alias("shared")
    )
    opened = stage(opened, "openings")
    shared = opened.select("conv_id", F.inline("shared"))
    shared = shared.select("conv_id", (F.col("place") + 1).alias("depth"), "a", "b", "words")
    own = turns.join(opened.select("conv_id", "taken", F.size("shared").alias("n")), "conv_id").where("place >= taken")
    own = own.select("conv_id", (F.col("place") - F.col("taken") + F.col("n") + 1).alias("depth"), "a", "b", "words")
    return trie.prefix_trie(shared.unionByName(own), opened.select("conv_id"))
