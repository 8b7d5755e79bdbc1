"""One query per operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.llm import ann, audit, bpe, chat, ctw, decontam, langid, ngram_join, quality, repair, simhash, sitetree, substring
from crivo.llm.common import crc_remainder, table
from crivo.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query()
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    remainder = crc_remainder("doc_id", 4)
    filters = langid.learn(docs.where(remainder != 2))
    texts = docs.select("doc_id", (remainder == 2).alias("held_out"), "text")
    return langid.identify(texts, filters).select("doc_id", "held_out", "lang_pred", "score")


@query()
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the smallest document it is linked to."""
    found = simhash.classes(table(spark, sf_dir, "documents"), width=3)
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select(F.col("id").alias("doc_id"), fingerprint, F.col("component").alias("component_id"))


OP10_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, s, array_to_string(w[s : s + 19], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as s from d where len(w) >= 20)),
again as (select doc_id, s from (select doc_id, s, row_number() over (partition by g order by doc_id, s) as r from win) where r > 1),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(s, s + 20)) as p from again)),
said as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select said.doc_id, string_agg(word, ' ' order by said.p) as k, count(*) as n
  from said left join gone on said.doc_id = gone.doc_id and said.p = gone.p where gone.p is null group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join kept using (doc_id)
"""


@query(OP10_SQL)
def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that no earlier passage of 20 words has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring.without_repeats(docs, width=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from i where len(w) > 0)),
sizes as (select distinct n from win),
said as (
  select doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)),
hit as (select doc_id, item_id, s, said.n as n from said join win on said.n = win.n and said.g = win.g),
covered as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from (select distinct doc_id, s, n from hit))
  group by 1),
found as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as id from hit) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join found using (doc_id)
"""


@query(OP4_SQL)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items in every document."""
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.encode(F.array_join("items", ","), "UTF-8")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    """The text of an installed tokenizer file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@query()
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text decoded from them."""
    encoded = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_json())
    return bpe.digests(encoded).withColumnRenamed("id", "doc_id")


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels of those not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = crc_remainder("doc_id", 4)
    ranking = quality.learn(docs.where(remainder != 2), labels.where(remainder != 2))
    rows = docs.select("doc_id", (remainder == 2).alias("held_out"), "text")
    return quality.score(rows, ranking).withColumn("predicted", quality.predicted(F.col("score")))


@query()
def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document, learned from those not held out."""
    found = ctw.scores(table(spark, sf_dir, "documents"), crc_remainder("doc_id", 5) == 1)
    bits = (-F.col("score") * 3.321928094887362 / F.col("n_bytes")).alias("bits_per_byte")
    return found.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits)


@query()
def op3_sitetree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = sitetree.main_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors of every vector whose id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


OP9_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
measured as (
  select *, 4 + length(role) + len(regexp_extract_all(role, '\\|###|</turn>|<\||:')) + 2
    + length(text) + len(regexp_extract_all(text, '\\|###|</turn>|<\|')) + 8 as n from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from measured group by conv_id
"""


@query(OP9_SQL)
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from every formatted conversation, and one that holds control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    added = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.expr("if(id = 0, 'user', 'assistant')"), F.lit(tricky))
    formatted = chat.format_turns(turns.union(added), chat.text_part(F.col("text")))
    return chat.read_back(formatted).withColumnRenamed("conv", "conv_id")


OP11_SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
failed as (
  select doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask from d),
said as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by 1),
counted as (
  select part, mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n
  from failed left join said using (doc_id) group by all),
letter as (select unnest(range(5)) as i),
orders as (
  select [a.i, b.i, c.i, d.i, e.i] as o from letter a join letter b on b.i != a.i join letter c on c.i not in (a.i, b.i)
  join letter d on d.i not in (a.i, b.i, c.i) join letter e on e.i not in (a.i, b.i, c.i, d.i)),
steps as (
  select list_aggregate(list_transform(o, lambda i: chr((65 + i)::int)), 'string_agg', '') as filter_order, step::int as step,
    (1 << o[step])::int as own, coalesce(list_sum(list_transform(o[1 : step - 1], lambda i: 1 << i)), 0)::int as before
  from (select o, unnest(range(1, 6)) as step from orders)),
both_ as (select *, mask & own != 0 as fails, mask & before != 0 as earlier from counted, steps)
select part, filter_order, step, cast(sum(if(not fails and not earlier, n, 0)) as bigint) as kept,
  cast(sum(if(fails and not earlier, n, 0)) as bigint) as removed, cast(sum(if(fails and earlier, n, 0)) as bigint) as redundant,
  cast(sum(if(mask = own, n, 0)) as bigint) as unique_fails, cast(sum(if(fails and not earlier and good, n, 0)) as bigint) as good_lost,
  cast(sum(if(fails and not earlier and toxic, n, 0)) as bigint) as toxic_lost,
  cast(sum(if(fails, n * 120 // bit_count(mask), 0)) as bigint) as shapley
from both_ group by all
"""


@query(OP11_SQL)
def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, by language."""
    found = audit.masks(table(spark, sf_dir, "documents"))
    return audit.interactions(audit.labelled(found, table(spark, sf_dir, "labels")))


OP12_SQL = r"""
with recursive crc as (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1))) as t),
named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda c: ascii(c)::bigint) as bytes
  from conversations),
kinds as (
  select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind
  from named, crc),
damaged as (
  select conv_id, turn, if(kind = 4, 'user', role) as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from (select *, unnest(range(if(kind = 0, 0, if(kind = 3, 2, 1)))) from kinds)),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
    right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) as last from damaged),
judged as (
  select *, last = '' as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as seen, last not in ('.', '!', '?') as cut,
    left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) as before from placed),
faults as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
    count(*) filter (not blank and seen) as duplicate, count(*) filter (not blank and not seen and cut) as truncated,
    count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from judged group by conv_id),
convs as (select c.conv_id, coalesce(n, 0) as n from (select distinct conv_id from conversations) c left join faults f on c.conv_id is not distinct from f.conv_id),
gap (a, b, letters, cost, said) as (values
  (0, 0, '', 0, []::varchar[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 5, ['user:']), (1, 2, 'I', 5, ['user:']),
  (3, 2, 'I', 5, ['user:']), (2, 3, 'I', 5, ['assistant:']), (0, 3, 'II', 10, ['user:', 'assistant:']), (1, 3, 'II', 10, ['user:', 'assistant:'])),
edit (a, b, letter, cost, role) as (values
  (0, 0, 'D', 2, ''), (1, 1, 'D', 2, ''), (2, 2, 'D', 2, ''), (3, 3, 'D', 2, ''), (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'),
  (2, 3, 'K', 0, 'a'), (3, 2, 'K', 0, 'u'), (0, 2, 'R', 1, 'user'), (1, 2, 'R', 1, 'user'), (2, 3, 'R', 1, 'assistant'), (3, 2, 'R', 1, 'user')),
paths as (
  select conv_id, n, 0 as i, 0 as state, 0 as cost, '' as audit, []::varchar[] as said from convs
  union all
  select conv_id, n, i, state, cost, audit, said from (
    select *, row_number() over (partition by conv_id, state order by cost, audit) as place from (
      select p.conv_id, p.n, p.i + 1 as i, e.b as state, p.cost + g.cost + e.cost + if(e.letter <> 'D' and w.cut, 5, 0) as cost, p.audit || g.letters || e.letter as audit,
        p.said || g.said || case e.letter when 'D' then [] when 'K' then [w.role || ':' || w.text] else [e.role || ':' || w.text] end as said
      from paths p join gap g on g.a = p.state join judged w on w.conv_id is not distinct from p.conv_id and w.i = p.i + 1
      join edit e on e.a = g.b and (e.letter = 'D' or not w.blank and not w.seen and (e.letter = 'R' or e.role = w.initial))))
  where place = 1),
ended as (
  select p.conv_id, p.cost + g.cost as cost, p.audit || g.letters as audit, p.said || g.said as said,
    row_number() over (partition by p.conv_id order by p.cost + g.cost, p.audit || g.letters) as place
  from paths p join gap g on g.a = p.state where p.i = p.n and g.b in (0, 3))
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, cost::bigint as cost, audit,
  sha256(array_to_string(said, chr(10))) as repaired_sha256
from ended e left join faults f on e.conv_id is not distinct from f.conv_id where place = 1
"""


@query(OP12_SQL)
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and the cheapest repair."""
    return repair.repaired(repair.damage(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


@query()
def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shingles of every document and the smallest document it is linked to by similar ones."""
    found = ngram_join.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
