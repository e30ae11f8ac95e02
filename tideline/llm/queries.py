"""The queries of this package, by the names they are registered under."""

from __future__ import annotations

from tideline.llm.decontaminate import op8_decontaminate
from tideline.llm.divergence import OP11_SQL, op11_source_divergence
from tideline.llm.exact_dedup import OP13_SQL, op13_exact_dedup
from tideline.llm.fingerprint import op6_fingerprint
from tideline.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from tideline.llm.language_id import op4_language_id
from tideline.llm.licenses import op3_license_scan
from tideline.llm.packing import op9_best_fit_packing
from tideline.llm.quality import op1_quality
from tideline.llm.simhash import op7_simhash
from tideline.llm.substring_dedup import op5_substring_dedup
from tideline.llm.suffix_dedup import op10_suffix_dedup
from tideline.llm.token_file import op2_token_file

QUERIES = {
    "op1_quality": op1_quality,
    "op2_token_file": op2_token_file,
    "op3_license_scan": op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_fingerprint": op6_fingerprint,
    "op7_simhash": op7_simhash,
    "op8_decontaminate": op8_decontaminate,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_exact_dedup": op13_exact_dedup,
}
_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
#: Windows as joined strings and an equi-join, in place of the automaton.
ORACLES: dict[str, str] = {
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op11_source_divergence": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_exact_dedup": OP13_SQL,
}
