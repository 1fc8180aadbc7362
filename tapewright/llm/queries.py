"""The registered query of each operator, and its SQL twin where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.llm import (
    block_labeller, byte_bpe, cost_packing, exact_copies, fair_mix, host_rules, line_runs, mask_search, noisy_or,
    periodic_runs, simhash, tool_links, window_repeats,
)
from tapewright.llm.common import words

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark, sf_dir, name, *columns):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


SQL_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def vocabulary():
    """Path of the byte-level vocabulary; a module of the machine's tokenizer files knows it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_block_labeller")
def op1(spark, sf_dir):
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    found = block_labeller.extract(pages, block_labeller.fit(pages))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op2_simhash")
def op2(spark, sf_dir):
    """Every document's fingerprint and component."""
    marked = simhash.mark(table(spark, sf_dir, "documents", "doc_id", "text"))
    return marked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_line_runs", r"""
with d as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
e as (select r, doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as p from d),
f as (
  select *, row_number() over (partition by r order by p) as k
  from e where regexp_matches(line, '[^\x20\x09-\x0D]')),
w as (
  select r, doc_id, k, line || chr(10) || lead(line) over o || chr(10) || lead(line, 2) over o as run
  from f window o as (partition by r order by k)),
late as (
  select r, k from (select *, row_number() over (partition by run order by doc_id nulls last, k) as n
                    from w where run is not null) where n > 1),
gone as (
  select distinct f.r, f.p from (select r, unnest(range(k, k + 3)) as k from late) g join f on f.r = g.r and f.k = g.k),
kept as (
  select e.r, string_agg(line, chr(10) order by e.p) as kept
  from e left join gone on e.r = gone.r and e.p = gone.p where gone.p is null group by e.r),
n as (select r, count(*) as n from f group by r),
m as (select r, count(*) as n from gone group by r)
select doc_id, coalesce(n.n, 0) as n_lines, coalesce(m.n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept on d.r = kept.r left join n on d.r = n.r left join m on d.r = m.r
""")
def op3(spark, sf_dir):
    """Every document's lines, how many are later copies of runs, and a digest of the rest."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = line_runs.remove_runs(docs, finish=lambda kept: F.sha2(kept, 256))
    return out.withColumnRenamed("kept", "kept_sha256")


@query("op3_short_line_runs", r"""
with d as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
e as (select r, doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as p from d),
f as (
  select *, row_number() over (partition by line order by doc_id nulls last, p) as n
  from e where regexp_matches(line, '[^\x20\x09-\x0D]')),
kept as (
  select e.r, string_agg(e.line, chr(10) order by e.p) as kept
  from e left join f on e.r = f.r and e.p = f.p where coalesce(f.n, 1) = 1 group by e.r),
n as (select r, count(*) as n, count(*) filter (n > 1) as m from f group by r)
select doc_id, coalesce(n.n, 0) as n_lines, coalesce(n.m, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept on d.r = kept.r left join n on d.r = n.r
""")
def op3_short(spark, sf_dir):
    """As op3_line_runs, with repeated runs of one and two lines removed as well."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = line_runs.remove_runs(docs, finish=lambda kept: F.sha2(kept, 256), short_words=1)
    return out.withColumnRenamed("kept", "kept_sha256")


@query("op4_window_repeats", r"""
with d as (
  select row_number() over () as r, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
g as (select r, doc_id, unnest(range(1, len(w) - 48)) as i, w from d where len(w) >= 50),
h as (select r, doc_id, i, array_to_string(w[i:i + 49], ' ') as gram from g),
f as (select *, min(doc_id) over (partition by gram) as first_id from h),
gone as (select distinct r, unnest(range(i, i + 50)) as p from f where first_id < doc_id),
k as (select d.r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
left_over as (
  select k.r, string_agg(word, ' ' order by k.p) as kept, count(*) as n
  from k left join gone on k.r = gone.r and k.p = gone.p where gone.p is null group by k.r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from d left join left_over on d.r = left_over.r
""")
def op4(spark, sf_dir):
    """Every document's words, how many repeat from smaller ids, and a digest of the rest."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = window_repeats.remove_repeats(docs, finish=lambda kept: F.sha2(kept, 256))
    return out.withColumnRenamed("kept", "kept_sha256")


@query("op5_fair_mix", rf"""
with d as (
  select doc_id, source, len({SQL_WORDS}) as size,
         md5('{fair_mix.SEED}:' || coalesce(cast(doc_id as varchar), 'null') || ':' || coalesce(text, '')) as ticket
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as rank from s),
c as (select *, cast([5.0, 2.0, 1.0][rank % 3 + 1] as double) as weight, cast(3 * source_size as double) as cap from r),
l as (
  select *, (sum(cast(source_size as double)) over ()
      - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0.0))
      / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as lev
  from c),
t as (select *, least(cap, max(lev) over () * weight) as target from l),
p as (
  select d.doc_id, d.size, d.ticket, t.source_size, t.target, t.weight, t.rank,
         sum(d.size) over (partition by t.rank order by d.ticket) as place
  from d join t on d.source is not distinct from t.source),
q as (
  select p.*, e.round, (e.round * source_size + place) / weight as finish
  from p, (select unnest([0, 1, 2]) as round) e where size > 0),
f as (select *, sum(size) over (order by finish, rank) as so_far from q),
taken as (
  select rank, ticket, count(*) as n from (select distinct rank, ticket, round from f
    where so_far <= (select sum(size) from d)) group by rank, ticket)
select p.doc_id, p.size, p.source_size, p.target, cast(p.size * coalesce(k.n, 0) as bigint) as taken
from p left join taken k on p.rank = k.rank and p.ticket = k.ticket
""")
def op5(spark, sf_dir):
    """Every document, with the words that the mix takes of it."""
    return fair_mix.mark(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


# The conversations hold no calls, so Spark reads them as such: an assistant turn calls a
# tool, the turn after it is the result. Ids, tools, needs and flaws follow from the
# conversation and turn numbers, arguments and contents from the texts.
TOOLS = ("count", "find", "show")
SCHEMAS = {
    "count": {"type": "object", "required": ["chars", "of"], "additionalProperties": False, "properties": {
        "chars": {"type": "integer", "minimum": 1, "maximum": 600}, "of": {"enum": ["chars", "words"]}}},
    "find": {"type": "object", "required": ["text"], "properties": {
        "text": {"type": "string", "minLength": 2}, "deep": {"type": "boolean"}}},
    "show": {"type": "object", "required": ["lines"], "properties": {
        "lines": {"type": "array", "minItems": 1, "items": {"type": "integer"}}}},
}


def calls_and_results(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    ident = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    before = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 2).cast("string"))
    asked = turns.where("role = 'assistant'")
    tool = F.element_at(F.array(*map(F.lit, (*TOOLS, "none"))), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    head = F.coalesce(F.element_at(F.split("text", "[^a-zA-Z]+"), 1), F.lit(""))
    size = F.coalesce(F.char_length("text"), F.lit(0)).cast("string")
    # White space and key order vary on purpose: canonical JSON must not.
    arguments = (F.when(F.col("tool") == "count", F.concat(F.lit('{ "of": "chars",\n "chars":'), size, F.lit(" }")))
                 .when(F.col("tool") == "find", F.concat(F.lit('{"text": "'), head, F.lit('", "deep": true}')))
                 .when(F.col("tool") == "show", F.concat(F.lit('{"lines": ['), size, F.lit(", 7]}")))
                 .otherwise(F.lit("{not json")))
    calls = asked.select("conv_id", "turn", ident.alias("call_id"), tool.alias("tool"), "text",
                         F.when(F.col("conv_id") % 7 == 0, F.array(before, F.lit("c-none"))).otherwise(
                             F.array(before)).alias("needs")).withColumn("arguments", arguments)
    owner = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 1).cast("string"))
    results = turns.where("turn > 0 and role = 'user'").select("conv_id", "turn", owner.alias("call_id"),
                                                                F.col("text").alias("content"))
    plain = turns.where("role is null or role not in ('assistant', 'user') or (role = 'user' and turn = 0)")
    return calls, results, plain.withColumnRenamed("text", "content")


@query("op6_tool_links", r"""
with a as (
  select conv_id, turn, 'c' || conv_id || '-' || turn as call_id, 'c' || conv_id || '-' || (turn - 2) as need,
         ['count', 'find', 'show', 'none'][(conv_id + turn) % 4 + 1] as tool,
         coalesce(length(text), 0) as size, coalesce(regexp_extract(text, '^[a-zA-Z]*'), '') as head
  from conversations where role = 'assistant'),
r as (
  select conv_id, turn, 'c' || conv_id || '-' || (turn - 1) as call_id, text from conversations
  where turn > 0 and role = 'user'),
l as (
  with recursive up(conv_id, call_id, turn, level) as (
    select conv_id, call_id, turn, 0 from a where need not in (select call_id from a)
    union all
    select a.conv_id, a.call_id, a.turn, up.level + 1 from up join a on a.need = up.call_id)
  select * from up),
calls as (
  select a.conv_id, a.turn, 'call' as kind, a.call_id, l.level,
         case when r.call_id is null then 'open' else 'linked' end as status,
         case when tool = 'none' then 'no JSON'
              when tool = 'count' and not size between 1 and 600 then '$.chars: out of range'
              when tool = 'find' and length(head) < 2 then '$.text: length ' || length(head) else '' end as problems,
         '{"role":"assistant","tool_call":{"arguments":' || case tool
           when 'count' then '{"chars":' || size || ',"of":"chars"}' when 'find' then '{"deep":true,"text":"' || head || '"}'
           when 'show' then '{"lines":[' || size || ',7]}' else '{"unparsed":"{not json"}' end
           || ',"id":"' || a.call_id || '","name":"' || tool || '"}}' as message
  from a join l on a.call_id = l.call_id left join r on a.call_id = r.call_id),
results as (
  select r.conv_id, r.turn, 'result', r.call_id, l.level, case when a.call_id is null then 'orphan' else 'linked' end, '',
         '{"content":' || coalesce(cast(to_json(text) as varchar), 'null') || ',"name":'
           || coalesce('"' || a.tool || '"', 'null') || ',"role":"tool","tool_call_id":"' || r.call_id || '"}'
  from r left join a on a.call_id = r.call_id left join l on l.call_id = r.call_id)
select * from calls union all select * from results union all
select conv_id, turn, 'message', null, null, 'plain', '',
       '{"content":' || coalesce(cast(to_json(text) as varchar), 'null') || ',"role":'
         || coalesce('"' || role || '"', 'null') || '}'
from conversations where role is null or role not in ('assistant', 'user') or (role = 'user' and turn = 0)
""")
def op6(spark, sf_dir):
    """Every call and result that the conversations stand for, linked, ordered and checked; the other turns as they are."""
    calls, results, plain = calls_and_results(spark, sf_dir)
    linked = tool_links.link(calls, results, SCHEMAS, plain)
    return linked.withColumn("problems", F.array_join("problems", "; "))


@query("op7_noisy_or")
def op7(spark, sf_dir):
    """Every document's toxicity, learned from the labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = noisy_or.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return noisy_or.score(docs, model).select(
        "doc_id", noisy_or.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op8_cost_packing")
def op8(spark, sf_dir):
    """Every piece of every document, with its sequence and a checksum of its ids."""
    packed = cost_packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query("op9_exact_copies", """
with n as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by t)
select n.doc_id, g.keep_id, g.group_size, n.doc_id is not distinct from g.keep_id as kept, sha256(n.t) as text_sha256
from n join g on n.t = g.t
""")
def op9(spark, sf_dir):
    """Every document, with the row of its group of equal texts that stays."""
    return exact_copies.mark(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op10_host_rules", rf"""
with d as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as t, {SQL_WORDS} as w from documents),
g as (select r, unnest(range(1, len(w) - 6)) as i, w from d where len(w) >= 8),
h as (select r, i, array_to_string(w[i:i + 7], ' ') as gram from g),
again as (select *, count(*) over (partition by r, gram) as n from h),
rep as (
  select r, count(*) as n from (select distinct r, unnest(range(i, i + 8)) as p from again where n > 1) group by r),
m as (
  select d.r, doc_id, source, cast(len(w) as bigint) as n_words,
         cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
         coalesce(rep.n, 0) as n_repeat_words
  from d left join rep on d.r = rep.r),
k as (
  select *, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, len(lines) as n_lines,
         n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m),
j as (
  select *,
    base_failed or n_symbols > 0.1 * n_words or n_dup_lines > 0.3 * n_lines
      or word_chars < 3 * n_words or word_chars > 10 * n_words as narrow,
    base_failed or n_symbols > 0.3 * n_words or n_dup_lines > 0.5 * n_lines
      or word_chars < 2 * n_words or word_chars > 15 * n_words as wide from k),
hosts as (select source, count(*) as docs, sum(cast(narrow as int)) as fails from j group by source),
prior as (
  select sum(fails) / sum(docs) as mean, var_pop(fails / docs) as spread from hosts),
rates as (
  select source, case when spread > 0 then
      (fails + mean * greatest(mean * (1 - mean) / spread - 1, 0.001))
      / (docs + greatest(mean * (1 - mean) / spread - 1, 0.001)) else mean end as rate
  from hosts, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not case when rate > 0.35 then narrow else wide end as kept
from j join rates on j.source is not distinct from rates.source
""")
def op10(spark, sf_dir):
    """Every document's measures, the base verdict and the host-aware verdict."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    out, m, kept = host_rules.verdicts(docs, carry=["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    measures = F.col(m)
    return out.select("doc_id", *[measures[n].alias(n) for n in names],
                      host_rules.base_failed(measures).alias("base_failed"), F.col(kept).alias("kept"))


def rank_vocabulary():
    """Path of the byte-level vocabulary as ranks, and the pattern that cuts texts before it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op11_byte_bpe")
def op11(spark, sf_dir):
    """Every document's ids, and the bytes that they decode to, as digests."""
    vocabulary = rank_vocabulary()
    coded = byte_bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), *vocabulary)
    coded = coded.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                         F.sha2("ids", 256).alias("ids_sha256"))
    decoded = byte_bpe.decode(coded, *vocabulary, keys=("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("data", 256).alias("decoded_sha256"))


def with_periods(docs):
    """docs with every tenth text, by its hash, made periodic from some word on; words keep their number."""
    hashed = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.withColumn("g", F.floor(hashed / 10)).withColumn("w", F.when(hashed % 10 == 0, words(F.col("text"))))
    docs = docs.withColumn("n", F.size("w")).withColumn("a", F.expr("cast(if(n > 0, g % n, 0) as int)"))
    docs = docs.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    # The words before the period, then its words over and over.
    again = F.expr("""array_join(concat(slice(w, 1, a),
        slice(flatten(array_repeat(slice(w, a + 1, p), cast((n - a + p - 1) div p as int))), 1, n - a)), ' ')""")
    return docs.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    """Every document's periodic runs: their number, the most periodic, digests of all and of the words left."""
    found = periodic_runs.find(with_periods(table(spark, sf_dir, "documents", "doc_id", "text")))
    # Runs come by start and period, so only a greater exponent replaces the one before.
    best = F.expr("""aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) ->
        if(b is null or r.length * b.period > b.length * r.period, r, b))""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


@query("op13_mask_search", r"""
with t as (
  select doc_id, row_number() over () as r,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
q as (
  select distinct item_id, unnest(
      regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
d as (select r, doc_id, cast(len(terms) as bigint) as n from t where len(terms) > 0),
c as (select cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_terms from d),
p as (select r, term, cast(count(*) as bigint) as tf from (select r, unnest(terms) as term from t) group by r, term),
f as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as w
  from (select term, count(*) as df from p group by term), c),
s as (
  select item_id, d.r, any_value(doc_id) as doc_id,
         cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) as bigint) as score
  from q join f using (term) join p using (term) join d on p.r = d.r, c group by item_id, d.r)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from s where score > 0)
where rank <= 10
""")
def op13(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return mask_search.search(table(spark, sf_dir, "documents", "doc_id", "text"),
                              table(spark, sf_dir, "benchmark", "item_id", "text"))
