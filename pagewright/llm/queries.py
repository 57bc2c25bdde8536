"""The queries of the subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, classifier, fingerprints, html_text, language, license_scan, near_copies, packing, quality_rules, repeats

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.classes(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY, RANKS)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.stripped(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_near_copies, op3_quality_classifier, op4_bpe, op5_best_fit_packing, op6_fingerprints, op7_html_text, op8_language, op9_repeats, op10_license_scan)}


def license_sql() -> str:
    """The license scan by brute force: every block of words against every template."""
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    templates = ", ".join(f"('{label}', {sorted(own)})" for label, own in license_scan.template_words(license_scan.TEMPLATES))
    phrases = []
    for phrase, label in license_scan.PHRASES.items():
        test = " and ".join(["w = '%s'" % phrase.split()[0], *(f"w{k} = '{x}'" for k, x in enumerate(phrase.split()[1:], 1))])
        phrases.append(f"select doc_id, i, '{label}' as label from p where {test}")
    return f"""with d as (select doc_id, translate(coalesce(text, ''), '{license_scan.CAPITALS}', '{license_scan.SMALL}') as low from documents),
  w as (select doc_id, regexp_extract_all(low, '{word}') as ws from d),
  u as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from w),
  p as (select doc_id, i, w, lead(w, 1) over o as w1, lead(w, 2) over o as w2 from u window o as (partition by doc_id order by i)),
  f as ({" union all ".join(phrases)}),
  b as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from f group by doc_id),
  t(label, own) as (values {templates}),
  l as (select doc_id, ws, unnest(range(0, greatest(1, len(ws) - {license_scan.BLOCK - license_scan.STEP}), {license_scan.STEP})) as b from w where len(ws) > 0),
  s as (select doc_id, list_distinct(list_slice(ws, b + 1, b + {license_scan.BLOCK})) as ws from l),
  m as (select s.doc_id, t.label, len(list_intersect(s.ws, t.own)) / cast(len(t.own) as double) as share from s, t),
  k as (select doc_id, label, share from m where share >= {license_scan.CONTAINED} - 1e-12),
  e as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from k union all select doc_id, label from f) group by doc_id),
  h as (select doc_id, max(share) as share from k group by doc_id)
  select w.doc_id, cast(len(w.ws) as bigint) as n_words, coalesce(b.n_base, 0) as n_base, b.first_word, b.last_word, coalesce(b.base_labels, '') as base_labels, coalesce(e.labels, '') as labels,
  case when b.n_base > 0 then 1.0 else coalesce(h.share, 0.0) end as score
  from w left join b on w.doc_id = b.doc_id left join e on w.doc_id = e.doc_id left join h on w.doc_id = h.doc_id"""


def repeats_sql() -> str:
    """The removal of repeats by brute force: every window of 200 bytes, as hexadecimal digits."""
    return """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
  w as (select doc_id, i, hash(substr(h, cast(2 * i + 1 as bigint), 400)) as k from (select doc_id, h, unnest(range(0, n - 199)) as i from d where n >= 200)),
  r as (select k from w group by k having count(*) > 1),
  c as (select doc_id, i from w where k in (select k from r)),
  g as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 200 then 0 else 1 end as fresh from c),
  s as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from g),
  p as (select doc_id, run, min(i) as b, max(i) + 200 as e from s group by doc_id, run),
  q as (select p.doc_id, p.run, p.b, p.e, coalesce(lag(p.e) over (partition by p.doc_id order by p.b), 0) as before from p),
  k as (select q.doc_id, count(*) as n_spans, sum(q.e - q.b) as n_removed, max(q.e) as last, string_agg(substr(d.h, cast(2 * q.before + 1 as bigint), cast(2 * (q.b - q.before) as bigint)), '' order by q.b) as head from q join d on d.doc_id = q.doc_id group by q.doc_id)
  select d.doc_id, cast(d.n as bigint) as n_bytes, cast(coalesce(k.n_removed, 0) as bigint) as n_removed, coalesce(k.n_spans, 0) as n_spans,
  sha256(unhex(case when k.doc_id is null then d.h else k.head || substr(d.h, cast(2 * k.last + 1 as bigint)) end)) as kept_sha256
  from d left join k on k.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express; the other operators hash, learn or tokenize."""
    return {"op9_repeats": repeats_sql(), "op10_license_scan": license_sql()}
