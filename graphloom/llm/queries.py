"""The queries of this package, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import encoding, frequency, language, overlap, packing, spelling
from graphloom.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: spelling.found_copies(load(s, d, "edge_names")),
        "p1_collapsed": lambda s, d: spelling.collapse(load(s, d, "edge_names")),
        "p2_found": lambda s, d: frequency.found_labels(load(s, d, "graphs")),
        "p2_frequency": lambda s, d: frequency.label_frequency(load(s, d, "graphs")),
        "p4_found": lambda s, d: overlap.found_overlaps(load(s, d, "csr_offsets"), load(s, d, "csr_cols")),
        "p4_overlap": lambda s, d: overlap.overlap_report(load(s, d, "csr_offsets"), load(s, d, "csr_cols")),
        "p4_overlap_tenth": lambda s, d: overlap.overlap_report(load(s, d, "csr_offsets"), load(s, d, "csr_cols"), share=(1, 10)),
        "p4_overlap_checked": lambda s, d: overlap.checked_overlaps(load(s, d, "csr_offsets"), load(s, d, "csr_cols")),
        "p6_ids": lambda s, d: encoding.encoded(load(s, d, "documents")),
        "p6_decoded": lambda s, d: encoding.decoded(load(s, d, "documents")),
        "p7_packed": lambda s, d: packing.packed_documents(load(s, d, "documents"), load(s, d, "bin_capacity")),
        "p7_fill": lambda s, d: packing.packed_report(load(s, d, "documents"), load(s, d, "bin_capacity")).drop("containers", "least_containers"),
        "p8_found": lambda s, d: language.found_languages(load(s, d, "documents"), load(s, d, "lang_codes")),
        "p8_languages": lambda s, d: language.languages(load(s, d, "documents"), load(s, d, "lang_codes")),
        "p8_agreement": lambda s, d: language.agreement(load(s, d, "documents"), load(s, d, "lang_codes")),
    }


_P1 = r"""
WITH named AS (
  SELECT rec_id, regexp_replace(lower(begin_name), '[^\p{L}\p{M}\p{Nd}]', '', 'g') AS a,
         regexp_replace(lower(end_name), '[^\p{L}\p{M}\p{Nd}]', '', 'g') AS b
  FROM edge_names),
grouped AS (
  SELECT rec_id, min(rec_id) OVER (PARTITION BY least(a, b), greatest(a, b)) AS kept_id,
         count(*) OVER (PARTITION BY least(a, b), greatest(a, b)) AS copies
  FROM named WHERE a <> '' AND b <> '')
"""

_P2 = """
WITH record AS (SELECT DISTINCT graph_id, labels FROM graphs),
n AS (SELECT count(DISTINCT graph_id) AS n FROM graphs),
one AS (SELECT graph_id, unnest(labels) AS label FROM record),
f AS (SELECT label, count(*) AS occurrences, count(DISTINCT graph_id) AS records FROM one WHERE label IS NOT NULL GROUP BY label),
marked AS (SELECT f.*, CASE WHEN records <= 2 THEN 'rare' WHEN records * 10 > n * 4 THEN 'common' END AS mark FROM f, n)
"""

_P4 = """
WITH slice AS (SELECT DISTINCT v, off, deg FROM csr_offsets WHERE deg > 0),
long AS (SELECT * FROM slice WHERE v IN (SELECT v FROM slice GROUP BY v HAVING sum(deg) >= 100)),
place AS (SELECT v, unnest(range(off, off + deg)) AS pos FROM long),
member AS (SELECT DISTINCT v, nbr FROM place JOIN csr_cols USING (pos) WHERE nbr IS NOT NULL),
n AS (SELECT v, count(*) AS n FROM member GROUP BY v HAVING count(*) >= 100),
pair AS (SELECT a.v AS v_a, b.v AS v_b, count(*) AS shared FROM member a JOIN member b ON a.nbr = b.nbr AND a.v < b.v GROUP BY 1, 2),
sized AS (SELECT v_a, v_b, x.n AS n_a, y.n AS n_b, shared FROM pair JOIN n x ON x.v = v_a JOIN n y ON y.v = v_b)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT kept_id, rec_id FROM grouped WHERE rec_id > kept_id",
        "p1_collapsed": _P1 + "SELECT rec_id, copies FROM grouped WHERE rec_id = kept_id",
        "p2_found": _P2 + "SELECT label, mark FROM marked WHERE mark IS NOT NULL",
        "p2_frequency": _P2 + "SELECT label, occurrences, records, mark FROM marked",
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p7_fill": "SELECT bin_kind, true AS placed_once, true AS within, true AS near_least FROM bin_capacity",
        "p8_agreement": "SELECT count(*) AS documents, count(*) FILTER (lower(trim(d.lang, E' \\t\\n\\r')) IN (SELECT code FROM lang_codes)) AS labelled, true AS agrees, true AS ordered FROM documents d",
        "p4_found": _P4 + "SELECT v_a, v_b FROM sized WHERE shared * 2 >= least(n_a, n_b)",
        "p4_overlap_checked": _P4 + "SELECT v_a, v_b, n_a, n_b, shared, true AS close FROM sized WHERE shared * 10 >= least(n_a, n_b)",
    }
