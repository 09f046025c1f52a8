"""Queries p3, p6, p7 and p8."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.llm import cube_sample as cs
from seriesloom.llm import mixing as mx
from seriesloom.llm import packing as pk
from seriesloom.llm import same_look as sl
from seriesloom.runtime import cut, is_small, table


def p3_report(spark, d):
    sample, want = cs.draw(table(spark, d, "series_labels"), table(spark, d, "sample_targets"))
    return cs.sample_report(sample, want, table(spark, d, "per_concept_matched_n"))


def p3_found(spark, d):
    return cs.shortfalls(p3_report(spark, d))


def p3_sample(spark, d):
    return cs.draw(table(spark, d, "series_labels"), table(spark, d, "sample_targets"))[0].select("scheme_id", "corpus_id", "key")


def p6_packed(spark, d):
    return pk.pack_documents(table(spark, d, "documents"), table(spark, d, "container_specs"))


def p6_found(spark, d):
    return pk.oversize(p6_packed(spark, d))


def p6_report(spark, d):
    return pk.packing_report(p6_packed(spark, d), table(spark, d, "container_specs"))


def p6_checks(spark, d):
    """What must hold of every packing: all documents are there, no container holds more than its capacity, pieces cover
    their document without gap, and no document is split that fits."""
    packed, specs = p6_packed(spark, d), table(spark, d, "container_specs").select("spec_id", F.col("capacity_tokens").cast("long").alias("capacity"))
    packed = cut(packed.join(F.broadcast(specs) if is_small(specs) else specs, "spec_id"))
    count = lambda c: F.sum(c.cast("long"))
    docs = packed.groupBy("spec_id", "capacity", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.count("*").alias("pieces"))
    docs = docs.groupBy("spec_id").agg(F.count("*").alias("n_docs"), count(F.col("n") != F.col("end")).alias("broken"), count((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity"))).alias("needless"))
    full = packed.groupBy("spec_id", "capacity", "container").agg(F.sum("n_tokens").alias("n")).groupBy("spec_id").agg(count(F.col("n") > F.col("capacity")).alias("over"))
    return docs.join(full, "spec_id").select("spec_id", "n_docs", "over", "broken", "needless")


def p7_checks(spark, d):
    """What must hold of every mixture: a row for each target, none above its quota, no document above its cap, and shares of
    each mix that add up to 1."""
    targets, report = table(spark, d, "mix_targets"), p7_report(spark, d)
    x = report.join(targets.select("mix_id", "source", "max_repeats"), ["mix_id", "source"])
    over = F.sum((F.col("residual") > 1e-6).cast("long"))
    return x.groupBy("mix_id").agg(F.count("*").alias("n"), over.alias("over_quota"), F.sum((F.coalesce("most_copies", F.lit(0)) > F.col("max_repeats")).cast("long")).alias("over_cap"), F.round(F.sum("actual_share"), 6).alias("shares"))


def p7_report(spark, d):
    return mx.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_found(spark, d):
    return p7_report(spark, d).filter("falls_short").select("mix_id", "source")


def p7_mixture(spark, d):
    return mx.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_found(spark, d):
    return sl.same_look_pairs(table(spark, d, "documents"))


def p8_classes(spark, d):
    return sl.look_classes(table(spark, d, "documents"))


def p8_canonical(spark, d):
    return sl.canonical_documents(table(spark, d, "documents"))


def queries():
    return {f.__name__: f for f in (p3_found, p3_report, p3_sample, p6_found, p6_packed, p6_report, p6_checks, p7_checks, p7_found, p7_report, p7_mixture, p8_found, p8_classes, p8_canonical)}


_CLEAN = "lower(trim({}, chr(9) || chr(10) || chr(13) || ' '))"
_DEMAND = f"""
with m as (select distinct corpus_id, key, {_CLEAN.format("indicator")} as i, {_CLEAN.format("source")} as s from series_labels where corpus_id is not null and key is not null and {_CLEAN.format("indicator")} <> ''),
c as (select distinct corpus_id, key, case when i = 'other' then s || '-other' else i end as name from m),
n as (select corpus_id, count(distinct key) as n from c group by all),
a as (select corpus_id, name, count(distinct key) as k from c where name is not null group by all),
w as (select scheme_id, p.corpus_id, concept, coalesce(target_share, 0) as target_share, coalesce(k, 0) as n_avail, greatest(coalesce(min_keep, 0)::double, coalesce(target_share * sample_fraction, 0) * coalesce(n.n, 0)) as wanted
      from sample_targets t cross join (select distinct corpus_id from series_labels where corpus_id is not null) p left join n on n.corpus_id = p.corpus_id left join a on a.corpus_id = p.corpus_id and a.name = {_CLEAN.format("t.concept")}),
r as (select corpus_id, {_CLEAN.format("concept")} as name, max(n_avail)::int as n_reported from per_concept_matched_n group by all)
"""

# Sizes by letters in place of tokens: the cases are decided by far, whatever the tokenizer.
_SIZED = f"with d as (select doc_id, {_CLEAN.format('source')} as src, strlen(text) / 3.3 as n from documents)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _looks() -> str:
    """SQL that folds whole texts: a translation of single characters, then normalization; no segments, no context."""
    look = sl.Look(sl.confusable_letters())
    one, gone, many = {}, "", {}
    for cp in (*range(1, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE01F0)):
        c = chr(cp)
        new = look.fold(c)
        if new == "":
            gone += c
        elif len(new) > 1:
            many[c] = new
        elif new != c and c != "\r":
            one[c] = new
    text = f"translate(replace(text, chr(13) || chr(10), chr(10)), {_quoted(''.join(one) + gone)}, {_quoted(''.join(one.values()))})"
    for a, b in many.items():
        text = f"replace({text}, {_quoted(a)}, {_quoted(b)})"
    return f"with c as (select doc_id, text, nfc_normalize({text}) as look from documents where text is not null)"


def oracle_sql():
    looks = _looks()
    return {
        "p3_found": _DEMAND + "select scheme_id, corpus_id, concept from w where n_avail < wanted - 1e-9",
        # categories are disjoint in these tables and wanted numbers whole, so a balanced sample takes exactly them
        "p3_report": _DEMAND + f"""select scheme_id, w.corpus_id, concept, target_share, wanted, n_avail, n_reported, least(n_avail, ceil(wanted - 1e-9))::bigint as n_take, least(n_avail, ceil(wanted - 1e-9))::bigint as n_selected, 0::bigint as residual, n_avail < wanted - 1e-9 as too_few
from w left join r on r.corpus_id = w.corpus_id and r.name = {_CLEAN.format("w.concept")}""",
        "p6_found": _SIZED + " select spec_id, doc_id from d, container_specs where n > capacity_tokens",
        "p6_checks": "select spec_id, (select count(distinct doc_id) from documents) as n_docs, 0::bigint as over, 0::bigint as broken, 0::bigint as needless from container_specs where capacity_tokens > 0",
        "p7_checks": "select mix_id, count(*) as n, 0::bigint as over_quota, 0::bigint as over_cap, 1.0 as shares from mix_targets group by mix_id",
        "p7_found": _SIZED + f""", s as (select src, sum(n) as n from d group by src) select mix_id, source from mix_targets t left join s on s.src = {_CLEAN.format('t.source')}
where target_share * total_share * (select sum(n) from d) > max_repeats * coalesce(s.n, 0)""",
        "p8_found": looks + " select a.doc_id as doc_id_a, b.doc_id as doc_id_b from c a join c b on a.look = b.look and a.text <> b.text and a.doc_id < b.doc_id",
        "p8_classes": looks + " select doc_id, min(doc_id) over (partition by look) as class_id, count(*) over (partition by look) - count(*) over (partition by look, text) as n_links from c",
    }
