"""Registered queries of this package, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.llm import exact_dedup, html_template, license_scan, lm_score, mixing, near_dup, packing, pieces, quality, quotes, toxicity, turn_repair, vector_codes
from opsight.llm.common import table


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents")).drop("loss_tokens")


def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_template.extract_text(table(spark, folder, "pages"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_scan(table(spark, folder, "documents"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(table(spark, folder, "documents")).drop("class_distance", "word_distance")


def op5_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, folder, "documents"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


def op7_quotation_links(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.reply_threads(quotes.as_mail(table(spark, folder, "conversations")))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), size=3, similarity=0.85)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    encoded = pieces.encode_pieces(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("piece_ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"),
    )


def op12_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = turn_repair.damaged(table(spark, folder, "conversations"))
    return turn_repair.repair_digests(turn_repair.repair(turns))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_html_text": op2_html_text,
    "op3_license_scan": op3_license_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_lm_score": op5_lm_score,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quotation_links": op7_quotation_links,
    "op8_mixing": op8_mixing,
    "op9_near_dedup": op9_near_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_pieces": op11_pieces,
    "op12_turn_repair": op12_turn_repair,
    "op13_vector_codes": op13_vector_codes,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {}

ORACLE["op6_exact_dedup"] = f"""
with n as (select doc_id, {_LOWER} as t from documents),
     g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by t)
select n.doc_id, g.keep_id, g.group_size, n.doc_id is not distinct from g.keep_id as kept, sha256(t) as text_sha256
from n join g using (t)
"""

# A histogram of six classes and one of 16 common words and the rest; distances in the
# order the lists are read, so sums of doubles agree.
_DISTANCE = """
sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z:
    case when z[1] > 0 then (z[1] / {sp}) * log2(2.0 * (z[1] / {sp}) / (z[1] / {sp} + z[2] / {sq})) else 0.0 end
  + case when z[2] > 0 then (z[2] / {sq}) * log2(2.0 * (z[2] / {sq}) / (z[2] / {sq} + z[1] / {sp})) else 0.0 end)) / 2.0, 0.0))
"""


def _judged(name: str, sample: str) -> str:
    by_class = _DISTANCE.format(p="m.classes", q="r.classes", sp="list_sum(m.classes)", sq="list_sum(r.classes)")
    by_word = _DISTANCE.format(p="m.known", q="r.known", sp="list_sum(m.known)", sq="list_sum(r.known)")
    classes = ", ".join(f"sum(classes[{i}])::double" for i in range(1, 7))
    known = ", ".join(f"sum(known[{i}])::double" for i in range(1, 18))
    return f"""
{name}_ref as (select lang, [{classes}] as classes, [{known}] as known from {sample} group by lang),
{name} as (
  select m.*, case when n_chars >= 200 then {by_class} end as class_distance,
         case when n_words >= 70 then {by_word} end as word_distance
  from measured m left join {name}_ref r on m.lang is not distinct from r.lang)"""


_NEAR = "coalesce(class_distance <= 0.25, true) and coalesce(word_distance <= 0.28, true)"

ORACLE["op4_quality_rules"] = f"""
with t as (
  select doc_id, lang, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words
  from documents),
w as (select doc_id, lang, unnest(words) as word, generate_subscripts(words, 1) as i from t),
ranked as (
  select lang, word, row_number() over (partition by lang order by count(*) desc, word) as place
  from w group by lang, word),
common as (select lang, list(word order by place) as common from ranked where place <= 16 group by lang),
windows as (
  select doc_id, i, word || ' ' || lead(word, 1) over p || ' ' || lead(word, 2) over p || ' ' ||
         lead(word, 3) over p || ' ' || lead(word, 4) over p as win
  from w window p as (partition by doc_id order by i)),
counted as (select doc_id, i, count(*) over (partition by doc_id, win) as c from windows where win is not null),
spread as (
  select doc_id, least(5, coalesce(lead(i) over (partition by doc_id order by i) - i, 5)) as covered
  from counted where c > 1),
repeated as (select doc_id, sum(covered) as n_repeat_words from spread group by doc_id),
measured as (
  select t.doc_id, t.lang, len(words)::bigint as n_words, length(text) as n_chars,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
         len(lines)::bigint - len(list_distinct(lines))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         [capitals, length(text) - spaces - rest - capitals, digits, spaces, points, rest - digits - points]::double[] as classes,
         list_append(list_transform(range(1, 17), lambda k: len(list_filter(words, lambda x: x = common[k]))),
                     len(words) - len(list_filter(words, lambda x: list_contains(common, x))))::double[] as known
  from t left join common on t.lang is not distinct from common.lang
       left join repeated on t.doc_id = repeated.doc_id,
  lateral (select list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
                  length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) as capitals,
                  length(regexp_replace(text, '[\\p{{L}}\\x20\\x09-\\x0D]+', '', 'g')) as rest,
                  length(regexp_replace(text, '[^0-9]+', '', 'g')) as digits,
                  length(regexp_replace(text, '[^.,;:!?''"()\\-]+', '', 'g')) as points,
                  length(text) - length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as spaces) x),
{_judged("pooled", "(select * from measured where not (n_words < 10 or 100 * n_repeat_words > 20 * n_words))")},
trimmed as (select * from pooled where not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and {_NEAR}),
{_judged("final", "trimmed")}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and {_NEAR} as kept
from final
"""

ORACLE["op8_mixing"] = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(concat(coalesce(doc_id::varchar, ''), '|', md5(coalesce(text, '')))) as k
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from d group by source),
b as (select *, 2 * source_size as cap, sum(source_size) over () * 3 / 2.0::double as budget from s),
l as (
  select *, (budget - coalesce(sum(cap) over (order by cap / weight, source nulls last
                                              rows between unbounded preceding and 1 preceding), 0)::double)
            / (sum(weight) over (order by cap / weight, source nulls last
                                 rows between current row and unbounded following))::double as level
  from b),
t as (select *, least(cap::double, max(level) over () * weight) as target from l),
q as (
  select d.*, source_size, target, budget,
         sum(size) over (partition by d.source order by k)::double as until
  from d join t on d.source is not distinct from t.source),
e as (
  select size, budget, until / target as moment from q where size > 0
  union all select size, budget, (until + source_size) / target from q where size > 0),
c as (select coalesce(max(moment), -1.0) as cut from (select moment, budget, sum(size) over (order by moment) as used from e) where used <= budget)
select doc_id, size, source_size, target,
       case when size = 0 then 0
            else size * ((until / target <= cut)::int + ((until + source_size) / target <= cut)::int) end::bigint as taken
from q, c
"""


# Assignment, means, assignment, means, assignment: nearest entries by arg_min over (distance, index).
def _nearest(book: str) -> str:
    return f"""select n, p, min(struct_pack(d := d, e := e)) as best from (
    select k.n, k.p, b.e, list_sum(list_transform(list_zip(k.part, b.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from parts k join {book} b using (p)) group by n, p"""


def _moved(book: str, near: str) -> str:
    return f"""select b.p, b.e, coalesce(m.entry, b.entry) as entry from {book} b left join (
    select p, e, list(floor_mean order by i) as entry from (
      select k.p, best.e as e, i, ((sum(k.part[i]) - ((sum(k.part[i]) % count(*)) + count(*)) % count(*)) // count(*))::bigint as floor_mean
      from parts k join {near} using (n, p), range(1, 5) r(i) group by k.p, best.e, i) group by p, e) m
    on b.p = m.p and b.e = m.e"""


ORACLE["op13_vector_codes"] = f"""
with kept as (
  select row_number() over (order by vec_id nulls last, embedding) as n, vec_id, label,
         list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v
  from embeddings where len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding) and len(embedding) > 0),
parts as materialized (
  select n, p, v[(p - 1) * (len(v) // 16) + 1 : p * (len(v) // 16)] as part from kept, range(1, 17) r(p)),
book0 as materialized (select p, n - 1 as e, part as entry from parts where n <= 64),
near0 as materialized ({_nearest("book0")}),
book1 as materialized ({_moved("book0", "near0")}),
near1 as materialized ({_nearest("book1")}),
book2 as materialized ({_moved("book1", "near1")}),
near2 as materialized ({_nearest("book2")}),
coded as (
  select n, string_agg(lpad(format('{{:x}}', best.e), 2, '0'), '' order by p) as code, sum(best.d)::bigint as error
  from near2 group by n),
digest as (
  select sha256(string_agg(array_to_string(entry, ','), ',' order by p, e)) as codebooks_sha256 from book2),
labelled as (select vec_id, label, code, error from coded join kept using (n))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from labelled, digest
"""
