"""The queries of the training-data operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, staged, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_repeated_lines

    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
with lines as (
  select doc_id, generate_subscripts(l, 1) as place, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
), keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), frequent as (
  select key, max(doc_id) as top from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), marked as (
  select k.doc_id, k.place, k.line, f.key is not null and k.doc_id < f.top as gone from keyed k left join frequent f on k.key = f.key
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import read_tokens, write_tokens

    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import copies

    return copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
with s as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), o as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as nth from s group by source
), w as (
  select *, [3.0, 1.0, 2.0][nth % 3 + 1]::double as weight, 2.0::double * source_size as cap from o
), c as (
  select *, 1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, nth rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(weight) over (order by cap / weight, nth rows between current row and unbounded following) as heavy, row_number() over (order by cap / weight, nth) as place
  from w
), f as (
  select place as first_place, rest as first_rest, heavy as first_heavy from c where rest * weight <= cap * heavy order by place limit 1
), t as (
  select source, source_size, case when place < first_place then cap else first_rest * weight / first_heavy end as target,
    ((nth * 40503 + 42 * 9973) % 65536) / 65536.0::double as shift
  from c, f
), r as (
  select s.doc_id, s.size, t.source_size, t.target, t.shift, case when t.source_size > 0 then t.target / t.source_size else 0 end as each,
    row_number() over (partition by s.source order by s.size, s.doc_id) as rank
  from s join t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target, (least(floor(each * rank + shift) - floor(each * (rank - 1) + shift), ceil(each)) * size)::bigint as taken from r
"""


def op4_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_copies

    out = near_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_chats

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return digests(staged(format_chats(turns.unionByName(more)), "chats", "zstd"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan, shown

    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind_no <= 2)
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op7_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_embedding_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP8_SQL = """
with recursive v as materialized (select vec_id, embedding::double[] as e from embeddings),
p as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id, vec_id as reached from v union select r.vec_id, p.b from r join p on r.reached = p.a),
c as (select vec_id, min(reached) as component_id from r group by vec_id),
n as (select a, count(*) as n from p group by a)
select c.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, c.vec_id = c.component_id as kept from c left join n on n.a = c.vec_id
"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import mark_copies

    out = mark_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = r"""
with t as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
w as (select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id, count(*) over (partition by text_sha256) as group_size from t)
select doc_id, keep_id, group_size::bigint as group_size, doc_id = keep_id as kept, text_sha256 from w
"""


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, repair, summaries

    return summaries(repair(*damaged(table(spark, sf_dir, "conversations"))))


def _cheaper(*ways: str) -> str:
    """SQL of the least of some ways to a state: structs of lpad(cost) || letters, and the repaired lines."""
    return f"list_min([{', '.join(ways)}])"


def _way(state: str, cost: str, letter: str, line: str | None = None, when: str = "true") -> str:
    said = f"{state}.said" if line is None else f"{state}.said || case when {state}.said = '' then '' else chr(10) end || {line}"
    return f"case when {when} and {state} is not null then {{'k': lpad(({state}.k[:6]::int + {cost})::varchar, 6, '0') || {state}.k[7:] || '{letter}', 'said': {said}}} end"


def _op11_sql() -> str:
    """Forward over the rows: the least (cost, letters) of each state of the grammar, without layers of cost."""
    stays, kept = "fault is distinct from 'blank' and fault is distinct from 'duplicate'", "role || ':' || text"
    more = "case when fault = 'truncated' then 1 else 0 end"
    gone = {i: _way(f"s{i}", "3", "D") for i in range(4)}
    keep = lambda i, role: _way(f"s{i}", more, "K", kept, f"{stays} and role[:1] = '{role}'")
    reroled = lambda i, role: _way(f"s{i}", f"2 + {more}", "R", f"'{role}:' || text", stays)
    users = [f(i, r) for i in (0, 1, 3) for f, r in ((keep, "u"), (reroled, "user"))]
    inserted = [_way(f"s{i}", "2", "I", "'user:'") for i in (0, 1, 3)]
    return rf"""
with recursive raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::ubigint),
      lambda crc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::ubigint[], lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end, xor(crc, b)),
      4294967295::ubigint), 4294967295::ubigint) % 20 as harm
  from conversations
), harmed as (
  select conv_id, turn, case when harm = 4 then 'user' else role end as role,
    case when harm = 1 then '' when harm = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when harm = 3 then 2 else 1 end)) as copy
  from raw where harm <> 0
), placed as materialized (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
    lag(role[:1]) over (partition by conv_id order by turn nulls first, role, text, copy) as before
  from harmed
), judged as materialized (
  select *, case when not regexp_matches(text, '[^ 	-
]') then 'blank' when seen > 1 then 'duplicate' when not regexp_matches(text, '[.!?][ 	-
]*\z') then 'truncated' end as fault from placed
), convs as (select distinct conv_id from conversations),
ends as materialized (
  select c.conv_id, count(j.i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
    count(*) filter (fault = 'blank')::bigint as blank, count(*) filter (fault = 'duplicate')::bigint as duplicate, count(*) filter (fault = 'truncated')::bigint as truncated,
    count(*) filter (before is not null and before || role[:1] not in ('su', 'ua', 'au'))::bigint as illegal
  from convs c left join judged j on c.conv_id is not distinct from j.conv_id group by c.conv_id
), ways as (
  select conv_id, 0::bigint as i, {{'k': '000000', 'said': ''}} as s0, null::struct(k varchar, said varchar) as s1,
    {{'k': '000002I', 'said': 'user:'}} as s2, {{'k': '000004II', 'said': 'user:' || chr(10) || 'assistant:'}} as s3 from convs
  union all
  select conv_id, i, s0, s1, s2, {_cheaper("s3", _way("s2", "2", "I", "'assistant:'"))} as s3 from (
    select conv_id, i, s0, s1, {_cheaper("s2", *inserted)} as s2, s3 from (
      select w.conv_id, j.i, {gone[0]} as s0, {_cheaper(gone[1], keep(0, "s"))} as s1, {_cheaper(gone[2], *users)} as s2, {_cheaper(gone[3], keep(2, "a"), reroled(2, "assistant"))} as s3
      from ways w join judged j on w.conv_id is not distinct from j.conv_id and j.i = w.i + 1))
), best as (select e.*, list_min([w.s0, w.s3]) as b from ends e join ways w on e.conv_id is not distinct from w.conv_id and e.n = w.i)
select conv_id, gaps, blank, duplicate, truncated, illegal, b.k[:6]::bigint as cost, b.k[7:] as audit, sha256(b.said) as repaired_sha256 from best
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    from .vector_codes import compress

    made = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for book in made.books for x in book.ravel().tolist()).encode()).hexdigest()
    rows = staged(made.rows.select("vec_id", "label", "code", "error"), "codes")
    # A sum for each label, by map-side sums; a label may hold a third of the rows, which are not brought together.
    totals = staged(rows.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of"), "totals")
    small = totals.count() <= MOST_LABELS
    joined = rows.join(F.broadcast(totals) if small else totals, F.col("label").eqNullSafe(F.col("of")))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


#: Labels whose sums are broadcast (16 bytes each); with more the sums are joined by a shuffle.
MOST_LABELS = 100_000


def _op12_sql() -> str:
    """Four rounds written out: every part against every entry, in doubles that hold these integers exactly."""
    steps = []
    for k in range(5):
        steps.append(f"""near{k} as materialized (
  select p.vec_id, p.part, min({{'d': p.energy - 2 * list_dot_product(p.v, b.v) + b.energy, 'entry': b.entry}}) as m from parts p join book{k} b on p.part = b.part group by p.vec_id, p.part
)""")
        if k < 4:
            steps.append(f"""sums{k} as materialized (
  select part, entry, list(floor(total / n)::double order by pos) as v from (
    select p.part, a.m.entry as entry, pos, sum(p.v[pos]) as total, count(*) as n
    from near{k} a join parts p on a.vec_id = p.vec_id and a.part = p.part, unnest(range(1, len(p.v) + 1)) as u(pos) group by all) group by part, entry
), book{k + 1} as materialized (
  select b.part, b.entry, coalesce(s.v, b.v) as v, list_dot_product(coalesce(s.v, b.v), coalesce(s.v, b.v)) as energy from book{k} b left join sums{k} s on b.part = s.part and b.entry = s.entry
)""")
    chain = ", ".join(steps)
    return f"""
with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v, row_number() over (order by vec_id) as place from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (
  select *, list_dot_product(v, v) as energy from (
    select vec_id, place, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] as v from kept, unnest(range(4)) as u(part))
), book0 as materialized (select part, place - 1 as entry, v, energy from parts where place <= 256),
{chain}, digest as (
  select sha256(string_agg(array_to_string(list_transform(v, lambda x: x::bigint), ','), ',' order by part, entry)) as codebooks_sha256 from book4
), coded as (
  select vec_id, string_agg(lpad(lower(to_hex(m.entry)), 2, '0'), '' order by part) as code, sum(m.d)::bigint as error from near4 group by vec_id
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join kept using (vec_id), digest
"""


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("licences", lambda m: m.base)

    def labels(found):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m.label))), ",")

    starts = F.transform(base, lambda m: m.start)
    return out.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("licences")).alias("labels"), F.coalesce(F.array_max(F.transform("licences", lambda m: m.share)), F.lit(0.0)).alias("score"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in list(globals().items()) if k.startswith("op")}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op3_source_mixing": OP3_SQL, "op8_embedding_multi_index": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op11_structure_repair": _op11_sql(), "op12_vector_codes": _op12_sql()}
