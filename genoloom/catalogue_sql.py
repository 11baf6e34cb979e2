"""DuckDB SQL that must give the rows of the panel queries, written independently of them."""

from __future__ import annotations

_BASE = """
raw AS (
  SELECT k AS row_idx, CAST(k % 24 + 1 AS INTEGER) AS chrom, 1000 + 137 * k AS pos,
    CASE WHEN k % 97 = 0 THEN '.' ELSE 'rs' || k END AS id,
    CASE WHEN k % 40 = 19 THEN 'AT' ELSE substr(pair, 1, 1) END AS ref,
    CASE WHEN k % 40 = 19 THEN 'A' ELSE substr(pair, 2, 1) END AS alt
  FROM (SELECT k, CASE WHEN k % 50 = 7 THEN 'AT' WHEN k % 50 = 23 THEN 'CG' WHEN k % 50 = 41 THEN 'TA'
      WHEN (k // 12) % 2 = 1 THEN reverse(four) ELSE four END AS pair
    FROM (SELECT k, CASE (k // 3) % 4 WHEN 0 THEN 'AC' WHEN 1 THEN 'AG' WHEN 2 THEN 'CT' ELSE 'GT' END AS four
      FROM (SELECT CAST(p_partkey AS BIGINT) AS k FROM part)))
),
a AS (SELECT * FROM raw WHERE length(ref) = 1 AND length(alt) = 1 AND row_idx % 20 <> 3),
b AS (
  SELECT row_idx, chrom, pos, id,
    CASE WHEN t IN (6, 7) THEN alt WHEN t = 8 THEN translate(ref, 'ACGT', 'TGCA') WHEN t = 9 THEN translate(alt, 'ACGT', 'TGCA') ELSE ref END AS ref,
    CASE WHEN t IN (6, 7) THEN ref WHEN t = 8 THEN translate(alt, 'ACGT', 'TGCA') WHEN t = 9 THEN translate(ref, 'ACGT', 'TGCA')
      WHEN t = 11 THEN translate(alt, 'ACGT', 'CATG') ELSE alt END AS alt
  FROM (SELECT *, (row_idx // 7) % 12 AS t FROM raw WHERE length(ref) = 1 AND length(alt) = 1 AND row_idx % 10 <> 9)
),
c AS (SELECT row_idx, chrom, pos + 1500000 AS pos, 'bs' || row_idx AS id, ref, alt FROM a),
d AS (SELECT row_idx, chrom, pos, 'x' || row_idx AS id, ref, alt FROM a),
e AS (SELECT row_idx, chrom, pos * 3 + 17 AS pos, 'e' || row_idx AS id, ref, alt FROM a WHERE row_idx % 24 < 10),
smp AS (
  SELECT s, CASE WHEN s % 4 < 2 THEN 0 WHEN s % 4 = 2 THEN 1 ELSE 2 END AS input_idx,
    row_number() OVER (PARTITION BY CASE WHEN s % 4 < 2 THEN 0 WHEN s % 4 = 2 THEN 1 ELSE 2 END ORDER BY s) - 1 AS sample_ord,
    'S' || CASE WHEN s % 8 = 2 THEN s - 2 ELSE s END AS iid, CAST(s % 2 + 1 AS VARCHAR) AS sex, 'POP' || n_regionkey AS pop, s % 3 = 0 AS ph
  FROM (SELECT CAST(s_suppkey AS BIGINT) AS s, s_nationkey FROM supplier) JOIN nation ON s_nationkey = n_nationkey
),
dense AS (
  SELECT row_idx, input_idx, sample_ord, CASE WHEN h = 15 THEN NULL WHEN ph AND h % 3 = 1 THEN 2 * (row_idx % 2) ELSE h % 3 END AS g
  FROM (SELECT row_idx, input_idx, sample_ord, ph, (31 * row_idx + 17 * s + (row_idx * s) % 13) % 16 AS h FROM raw CROSS JOIN smp WHERE input_idx < 2)
),
sparse AS (
  SELECT row_idx, input_idx, sample_ord, v AS g FROM (SELECT row_idx, input_idx, sample_ord, s FROM raw CROSS JOIN smp WHERE input_idx = 2)
  LEFT JOIN (SELECT CAST(l_partkey AS BIGINT) AS p, CAST(l_suppkey AS BIGINT) AS q, max(CAST(l_quantity AS INTEGER)) % 3 AS v FROM lineitem GROUP BY 1, 2) ON p = row_idx AND q = s
),
"""


def _alignment(other: str = "b", key: str = "chr_pos", trust: bool = False, missing: str = "fill_missing", strand: str = "flip", where: str = "true", target: bool = False) -> str:
    """CTEs pair (joined) and al (action, reason)."""
    join = "o.chrom = a.chrom AND o.pos = a.pos" if key == "chr_pos" else "o.id = a.id"

    def side(table: str, i: int) -> str:
        return f"SELECT a.row_idx, a.id AS variant_id, a.chrom, a.pos, a.ref, a.alt, {i} AS input_idx, o.row_idx AS other_row, o.ref AS r2, o.alt AS a2 FROM (SELECT * FROM a WHERE {where}) a LEFT JOIN (SELECT * FROM {table} WHERE {where}) o ON {join}"

    both = side(other, 1) + (" UNION ALL " + side("a", 2) if target else "")
    return f"""
pair AS ({both}),
code AS (
  SELECT *, translate(r2, 'ACGT', 'TGCA') AS r3, translate(a2, 'ACGT', 'TGCA') AS a3, translate(ref, 'ACGT', 'TGCA') = alt AS amb FROM pair
),
outcome AS (
  SELECT *, CASE
    WHEN other_row IS NULL THEN '{"drop:on_missing_drop" if missing == "drop_variant" else "fill_missing:"}'
    WHEN amb AND NOT ((r2 = ref AND a2 = alt) OR (r2 = alt AND a2 = ref)) THEN 'drop:allele_mismatch'
    WHEN amb THEN '{"passthrough:" if trust else "drop:ambiguous_strand"}'
    WHEN r2 = ref AND a2 = alt THEN 'passthrough:'
    WHEN r2 = alt AND a2 = ref THEN 'ref_alt_swap:'
    WHEN r3 = ref AND a3 = alt THEN '{"drop:on_strand_drop" if strand == "drop" else "strand_flip:"}'
    WHEN r3 = alt AND a3 = ref THEN '{"drop:on_strand_drop" if strand == "drop" else "strand_flip_and_swap:"}'
    ELSE 'drop:allele_mismatch' END AS both_ FROM code
),
al AS (SELECT *, split_part(both_, ':', 1) AS action, split_part(both_, ':', 2) AS reason FROM outcome),
kept AS (SELECT row_idx, variant_id, chrom, pos FROM al GROUP BY ALL HAVING NOT bool_or(action = 'drop')),
"""


def _q(select: str, *ctes: str) -> str:
    return "WITH " + (_BASE + "".join(ctes)).rstrip().rstrip(",") + "\n" + select


_ACTIONS = "SELECT variant_id, chrom, pos, input_idx, action, reason FROM al"
_HISTOGRAM = """
  CAST(count(*) FILTER (action = 'passthrough') AS BIGINT) AS passthrough,
  CAST(count(*) FILTER (action = 'ref_alt_swap') AS BIGINT) AS swap,
  CAST(count(*) FILTER (action LIKE 'strand_flip%') AS BIGINT) AS flip,
  CAST(count(*) FILTER (action = 'fill_missing') AS BIGINT) AS fill_missing,
  CAST(count(*) FILTER (reason = 'ambiguous_strand') AS BIGINT) AS dropped_ambiguous_strand,
  CAST(count(*) FILTER (reason = 'allele_mismatch') AS BIGINT) AS dropped_allele_mismatch,
  CAST(count(*) FILTER (reason = 'on_strand_drop') AS BIGINT) AS dropped_on_strand,
  CAST(0 AS BIGINT) AS pre_alignment_filter_dropped,
  CAST(count(*) FILTER (reason = 'on_missing_drop') AS BIGINT) AS "drop"
FROM al"""

_PLAN = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY input_idx, sample_ord) AS rn FROM smp),
suffix AS (
  SELECT input_idx, sample_ord, iid AS iid_in, CASE WHEN rn = 1 THEN iid WHEN input_idx = 2 THEN iid || '_target' ELSE iid || '_' || input_idx END AS iid_out,
    row_number() OVER (ORDER BY input_idx, sample_ord) - 1 AS out_ord FROM ranked
),
"""
_BOUND = """
cell AS (
  SELECT k.row_idx, k.chrom, k.pos, 0 AS input_idx, x.sample_ord, x.g FROM kept k JOIN dense x ON x.row_idx = k.row_idx AND x.input_idx = 0
  UNION ALL
  SELECT k.row_idx, k.chrom, k.pos, 1, p.sample_ord, CASE WHEN z.action IN ('ref_alt_swap', 'strand_flip_and_swap') THEN 2 - x.g ELSE x.g END
  FROM kept k JOIN al z ON z.row_idx = k.row_idx AND z.input_idx = 1 CROSS JOIN (SELECT sample_ord FROM smp WHERE input_idx = 1) p
    LEFT JOIN dense x ON x.row_idx = z.other_row AND x.input_idx = 1 AND x.sample_ord = p.sample_ord
  UNION ALL
  SELECT k.row_idx, k.chrom, k.pos, 2, x.sample_ord, x.g FROM kept k JOIN sparse x ON x.row_idx = k.row_idx
),
placed AS (SELECT cell.*, out_ord, iid_out FROM cell JOIN suffix USING (input_idx, sample_ord)),
counters AS (
  SELECT s.iid_out AS iid, s.input_idx, s.sample_ord, CAST(coalesce(sum(CASE WHEN g = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS het, count(g) AS called
  FROM suffix s LEFT JOIN (SELECT * FROM placed WHERE chrom <= 22) p ON p.out_ord = s.out_ord GROUP BY ALL
),
status AS (
  SELECT iid, input_idx, sample_ord, CASE WHEN called = 0 THEN 'U' WHEN het = 0 THEN '1' WHEN CAST(het AS DOUBLE) / CAST(called AS DOUBLE) >= CAST(0.05 AS DOUBLE) THEN '0' ELSE 'U' END AS status FROM counters
),
"""
_FULL = (_alignment(target=True), _PLAN, _BOUND)


def _afs(adjust: bool, chroms: int = 22, pops: str = "true") -> str:
    half = "ph" if adjust else "false"
    return f"""
f AS (
  SELECT a.row_idx, a.chrom, a.pos, a.id, pop,
    CAST(coalesce(sum(CASE WHEN {half} THEN g * CAST(0.5 AS DOUBLE) ELSE CAST(g AS DOUBLE) END), 0) AS DOUBLE) AS alt_count,
    CAST(coalesce(sum(CASE WHEN g IS NULL THEN 0 WHEN {half} THEN 1 ELSE 2 END), 0) AS BIGINT) AS called
  FROM a JOIN dense USING (row_idx) JOIN smp USING (input_idx, sample_ord) WHERE input_idx = 0 AND chrom <= {chroms} AND {pops} GROUP BY ALL
),
afs AS (SELECT *, CASE WHEN called > 0 THEN alt_count / CAST(called AS DOUBLE) END AS freq FROM f),
"""


_AFS = "SELECT chrom, pos, pop, alt_count, called, freq FROM afs"
_NAMED = "id NOT IN ('.', '', '0', 'NA', 'nan', 'None')"
_EMPTY = "(SELECT * FROM a WHERE false)"
_OTHERS = ("b", "c", "d", "e", _EMPTY)


def _inter(i: int, other: str, key: str) -> str:
    x = "chrom, pos" if key == "chr_pos" else "id"
    w = "true" if key == "chr_pos" else _NAMED
    return f"""SELECT {i} AS input_idx, '{key}' AS key, n_canonical, n_other, n_inter, CASE WHEN least(n_canonical, n_other) > 0 THEN CAST(n_inter AS DOUBLE) / CAST(least(n_canonical, n_other) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS frac FROM (
  SELECT (SELECT count(*) FROM (SELECT DISTINCT {x} FROM a WHERE {w})) AS n_canonical, (SELECT count(*) FROM (SELECT DISTINCT {x} FROM {other} WHERE {w})) AS n_other,
    (SELECT count(*) FROM (SELECT {x} FROM a WHERE {w} INTERSECT SELECT {x} FROM {other} WHERE {w})) AS n_inter)"""


def _chroms(i: int, other: str, key: str) -> str:
    x = "chrom, pos" if key == "chr_pos" else "chrom, id"
    w = "true" if key == "chr_pos" else _NAMED
    return f"""SELECT {i} AS input_idx, chrom, CAST(coalesce(max(x), 0) AS BIGINT) AS canonical_size, CAST(coalesce(max(y), 0) AS BIGINT) AS other_size, CAST(coalesce(max(z), 0) AS BIGINT) AS intersection FROM (
  SELECT chrom, count(*) AS x, 0 AS y, 0 AS z FROM (SELECT DISTINCT {x} FROM a WHERE {w}) GROUP BY chrom
  UNION ALL SELECT chrom, 0, count(*), 0 FROM (SELECT DISTINCT {x} FROM {other} WHERE {w}) GROUP BY chrom
  UNION ALL SELECT chrom, 0, 0, count(*) FROM (SELECT {x} FROM a WHERE {w} INTERSECT SELECT {x} FROM {other} WHERE {w}) GROUP BY chrom) GROUP BY chrom"""


def _shift(i: int, other: str) -> str:
    return f"""SELECT input_idx, chrom, m AS median_shift, round(mad / greatest(abs(m), CAST(1 AS DOUBLE)), 9) AS rel_mad, abs(m) >= 1000 AND mad / greatest(abs(m), CAST(1 AS DOUBLE)) <= CAST(0.1 AS DOUBLE) AS consistent FROM (
  SELECT {i} AS input_idx, chrom, any_value(m) AS m, median(abs(shift - m)) AS mad FROM (
    SELECT *, median(shift) OVER (PARTITION BY chrom) AS m FROM (
      SELECT chrom, CAST(y.pos - x.pos AS DOUBLE) AS shift FROM (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS rn FROM a) x
      JOIN (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS rn FROM {other}) y USING (chrom, rn)
      JOIN (SELECT chrom FROM ({_chroms(i, other, "chr_pos")}) WHERE canonical_size >= 5 AND other_size >= 5 AND intersection = 0) q USING (chrom))) GROUP BY chrom)"""


_SHIFTS = "shifts AS (" + " UNION ALL ".join(_shift(i, o) for i, o in enumerate(_OTHERS, 1)) + "),\n"


def _labels(key: str) -> str:
    other = "id" if key == "chr_pos" else "chr_pos"
    act = " UNION ALL ".join(_inter(i, o, key) for i, o in enumerate(_OTHERS, 1))
    alt = " UNION ALL ".join(_inter(i, o, other) for i, o in enumerate(_OTHERS, 1))
    chroms = " UNION ALL ".join(_chroms(i, o, key) for i, o in enumerate(_OTHERS, 1))
    return f"""SELECT input_idx, '{key}' AS variant_key, CASE
  WHEN n_other = 0 OR n_canonical = 0 THEN 'empty_input' WHEN frac >= 0.5 THEN 'compatible' WHEN alt - frac >= 0.4 THEN 'key_space_mismatch'
  WHEN shared > 0 AND apart = shared AND one_sided = 0 AND (evaluated = 0 OR good >= greatest(1, floor(0.5 * evaluated + 0.5))) THEN 'build_mismatch' ELSE 'disjoint_panels' END AS label
FROM (SELECT x.*, y.frac AS alt FROM ({act}) x JOIN ({alt}) y USING (input_idx))
JOIN (SELECT input_idx, count(*) FILTER (canonical_size > 0 AND other_size > 0) AS shared, count(*) FILTER (canonical_size > 0 AND other_size > 0 AND intersection = 0) AS apart,
  count(*) FILTER (canonical_size = 0 OR other_size = 0) AS one_sided FROM ({chroms}) GROUP BY 1) USING (input_idx)
JOIN (SELECT i AS input_idx, count(chrom) AS evaluated, count(*) FILTER (consistent) AS good FROM (SELECT unnest([1, 2, 3, 4, 5]) AS i) LEFT JOIN shifts ON shifts.input_idx = i GROUP BY 1) USING (input_idx)"""


_EDGES = ", ".join(f"CAST({x / 10} AS DOUBLE)" for x in range(1, 10))

SQL: dict[str, str] = {
    "scan_variants_snp_filter": _q("SELECT chrom, pos, id, ref, alt, row_idx FROM raw WHERE regexp_full_match(ref, '[ACGT]') AND regexp_full_match(alt, '[ACGT]')"),
    "chrom_normalize": _q("""SELECT row_idx, CASE k WHEN 0 THEN 'chr' || chrom WHEN 1 THEN 'chrX' WHEN 2 THEN ' mt ' WHEN 3 THEN 'CHRy' WHEN 4 THEN 'scaffold' || chrom WHEN 5 THEN CAST(chrom + 10 AS VARCHAR) ELSE 'M' END AS raw,
      CAST(CASE k WHEN 0 THEN chrom WHEN 1 THEN 23 WHEN 2 THEN 26 WHEN 3 THEN 24 WHEN 4 THEN NULL WHEN 5 THEN CASE WHEN chrom + 10 <= 26 THEN chrom + 10 END ELSE 26 END AS INTEGER) AS chrom FROM (SELECT *, row_idx % 7 AS k FROM raw)"""),
    "allele_complement": _q("SELECT DISTINCT ref, alt, translate(ref, 'ACGT', 'TGCA') AS cref, translate(alt, 'ACGT', 'TGCA') AS calt, translate(ref, 'ACGT', 'TGCA') = alt AS ambiguous FROM a"),
    "align_actions_chr_pos": _q(_ACTIONS, _alignment()),
    "align_actions_id": _q(_ACTIONS, _alignment(key="id", where="id <> '.'")),
    "align_trust_strand": _q(_ACTIONS, _alignment(trust=True)),
    "align_on_missing_drop": _q(_ACTIONS, _alignment(missing="drop_variant")),
    "align_on_strand_drop": _q(_ACTIONS, _alignment(strand="drop")),
    "align_action_histogram": _q("SELECT " + _HISTOGRAM, _alignment()),
    "align_action_histogram_strict": _q("SELECT " + _HISTOGRAM, _alignment(missing="drop_variant", strand="drop")),
    "align_action_histogram_per_chrom": _q("SELECT chrom, " + _HISTOGRAM + " GROUP BY chrom", _alignment()),
    "align_tally": _q("SELECT action, reason, count(*) AS n FROM al GROUP BY ALL", _alignment(target=True)),
    "align_kept_variants": _q("SELECT chrom, pos, variant_id FROM kept", _alignment(target=True)),
    "align_kept_count": _q("SELECT count(*) AS n FROM kept", _alignment()),
    "align_intersection_size": _q("SELECT count(DISTINCT row_idx) AS n FROM al WHERE action <> 'fill_missing'", _alignment()),
    "align_extras": _q("SELECT 1 AS input_idx, count(*) AS extras FROM (SELECT chrom, pos FROM b EXCEPT SELECT chrom, pos FROM a) UNION ALL SELECT 2, count(*) FROM (SELECT chrom, pos FROM c EXCEPT SELECT chrom, pos FROM a)"),
    "report_rows": _q('SELECT variant_id, chrom AS chr, pos, input_idx AS input_index, action, reason FROM al', _alignment(target=True)),
    "gate_extras": _q("""SELECT x AS numerator, n AS denominator, CAST(0.1 AS DOUBLE) AS threshold, CAST(x AS DOUBLE) > CAST(0.1 AS DOUBLE) * CAST(n AS DOUBLE) AS fires FROM (SELECT (SELECT count(*) FROM (SELECT chrom, pos FROM b EXCEPT SELECT chrom, pos FROM a)) + (SELECT count(*) FROM (SELECT chrom, pos FROM c EXCEPT SELECT chrom, pos FROM a)) AS x, (SELECT count(*) FROM a) AS n)"""),
    "gate_ambiguous": _q("SELECT x AS numerator, n AS denominator, CAST(5 AS DOUBLE) AS threshold, n > 0 AND CAST(x AS DOUBLE) / CAST(n AS DOUBLE) * 100 > 5 AS fires FROM (SELECT count(*) FILTER (reason = 'ambiguous_strand') AS x, count(DISTINCT row_idx) FILTER (action <> 'fill_missing') AS n FROM al)", _alignment()),
    "gate_target_call_rate": _q("SELECT iid, called AS numerator, n AS denominator, CAST(0.4 AS DOUBLE) AS threshold, CAST(called AS DOUBLE) / CAST(n AS DOUBLE) < CAST(0.4 AS DOUBLE) AS fires FROM counters CROSS JOIN (SELECT count(*) AS n FROM a) WHERE input_idx = 2", *_FULL),
    "gate_soft_errors": _q("""SELECT policy, n, n > 0 AS fires FROM (SELECT 'on_mismatch' AS policy, count(*) AS n FROM al WHERE reason = 'allele_mismatch' UNION ALL SELECT 'on_missing', count(*) FROM al WHERE action = 'fill_missing'
      UNION ALL SELECT 'on_extra', count(*) FROM (SELECT chrom, pos FROM b EXCEPT SELECT chrom, pos FROM a) UNION ALL SELECT 'on_strand', count(*) FROM al WHERE action LIKE 'strand_flip%')""", _alignment()),
    "iid_collisions": _q("SELECT iid, count(*) AS n FROM smp GROUP BY iid HAVING count(*) > 1"),
    "iid_first": _q("SELECT input_idx, sample_ord, iid AS iid_in, iid AS iid_out, row_number() OVER (ORDER BY input_idx, sample_ord) - 1 AS out_ord FROM ranked WHERE rn = 1", _PLAN),
    "iid_suffix_simple": _q("SELECT input_idx, sample_ord, iid_in, iid_out, out_ord FROM suffix", _PLAN),
    "relabel_two_col": _q("SELECT iid, pop AS pop_before, CASE pop WHEN 'POP0' THEN 'NORTH' WHEN 'POP1' THEN 'EAST' ELSE pop END AS pop_after FROM smp WHERE input_idx = 0"),
    "relabel_by_id": _q("SELECT iid, pop AS pop_before, CASE WHEN sample_ord % 3 = 0 THEN 'G' || sample_ord % 2 ELSE pop END AS pop_after FROM smp WHERE input_idx = 0"),
    "sample_union": _q("SELECT row_number() OVER (ORDER BY input_idx, sample_ord) - 1 AS out_ord, pop AS fid, iid, sex, pop, CASE WHEN input_idx = 1 THEN 'R' || substr(pop, 4) ELSE 'NA' END AS extra FROM ranked WHERE rn = 1", _PLAN),
    "dosage_swap": _q("SELECT z.row_idx AS canonical_row, CAST(sample_ord AS INTEGER) AS sample_ord, CAST(2 - g AS INTEGER) AS g FROM al z JOIN dense x ON x.row_idx = z.other_row AND x.input_idx = 1 WHERE action IN ('ref_alt_swap', 'strand_flip_and_swap')", _alignment()),
    "bind_long": _q("SELECT chrom, pos, out_ord, CAST(g AS INTEGER) AS g FROM placed", *_FULL),
    "bind_sample_counters": _q("SELECT iid, het, called FROM counters", *_FULL),
    "pseudohap_status": _q("SELECT iid, status FROM status", *_FULL),
    "pseudohap_mix": _q("SELECT status, count(*) AS n FROM status GROUP BY status", *_FULL),
    "pseudohap_sidecar": _q("SELECT iid, CASE WHEN input_idx = 0 AND sample_ord % 4 = 0 THEN '1' WHEN input_idx = 0 AND sample_ord % 2 = 0 THEN '0' ELSE status END AS status FROM status", *_FULL),
    "afs_diploid": _q(_AFS, _afs(False)),
    "afs_pseudohap_adjusted": _q(_AFS, _afs(True)),
    "afs_population_subset": _q(_AFS, _afs(True, pops="pop IN (SELECT DISTINCT pop FROM smp WHERE input_idx = 0 ORDER BY pop DESC LIMIT 2)")),
    "afs_sex_chrom": _q(_AFS, _afs(True, 26)),
    "afs_pivot_counts": _q("SELECT row_idx, any_value(id) AS variant_id, min_by(called, pop) AS first_pop, max_by(called, pop) AS last_pop, CAST(sum(called) AS BIGINT) AS all_pops FROM afs GROUP BY row_idx", _afs(True)),
    "afs_maxmiss_poly": _q("SELECT chrom, pos, bool_or(coalesce(freq > 0 AND freq < 1, false)) AS poly FROM afs GROUP BY row_idx, chrom, pos HAVING min(called) > 0", _afs(True)),
    "afs_samples_per_pop": _q("SELECT pop, count(*) AS n FROM smp WHERE input_idx = 0 GROUP BY pop"),
    "preflight_intersection": _q(" UNION ALL ".join(_inter(i, o, k) for i, o in enumerate(_OTHERS, 1) for k in ("chr_pos", "id"))),
    "preflight_per_chrom": _q(" UNION ALL ".join(_chroms(i, o, "chr_pos") for i, o in enumerate(_OTHERS, 1))),
    "preflight_per_chrom_id": _q(" UNION ALL ".join(_chroms(i, o, "id") for i, o in enumerate(_OTHERS, 1))),
    "preflight_shift_signature": _q("SELECT * FROM shifts", _SHIFTS),
    "preflight_classification": _q(f"SELECT * FROM ({_labels('chr_pos')}) UNION ALL SELECT * FROM ({_labels('id')})", _SHIFTS),
    "preflight_gate": _q(f"""SELECT policy, bad AS would_trigger, CASE WHEN NOT bad OR policy = 'off' THEN 'none' WHEN policy = 'warn' THEN 'warn' ELSE 'error' END AS action, pairs FROM (
      SELECT unnest(['off', 'warn', 'strict']) AS policy, pairs, bad FROM (SELECT 'all' AS pairs, bool_or(label <> 'compatible') AS bad FROM l UNION ALL SELECT 'good', bool_or(label <> 'compatible') FROM l WHERE input_idx IN (1, 3)))""", _SHIFTS, f"l AS ({_labels('chr_pos')}),"),
    "inspect_counts": _q("SELECT (SELECT count(*) FROM smp WHERE input_idx = 0) AS n_samples, (SELECT count(*) FROM raw) AS n_variants_pre_filter, (SELECT count(*) FROM a) AS n_variants_post_filter"),
    "inspect_populations": _q("SELECT pop, n, CAST(row_number() OVER (ORDER BY n DESC, f) - 1 AS INTEGER) AS rank FROM (SELECT pop, count(*) AS n, min(sample_ord) AS f FROM smp WHERE input_idx = 0 GROUP BY pop)"),
    "inspect_sex": _q("SELECT sex, count(*) AS n FROM smp WHERE input_idx = 0 GROUP BY sex"),
    "inspect_chrom_counts": _q("SELECT chrom, count(*) AS n FROM a GROUP BY chrom"),
    "inspect_missingness": _q("SELECT CAST(sample_ord AS INTEGER) AS out_ord, count(*) - count(g) AS missing, count(*) AS n FROM sparse GROUP BY sample_ord"),
    "inspect_missingness_hist": _q(f"""SELECT CAST(b AS INTEGER) AS bin, b * 10 || '-' || (b + 1) * 10 || '%' AS label, count(o) AS n FROM (SELECT unnest(range(10)) AS b)
      LEFT JOIN (SELECT sample_ord AS o, len(list_filter([{_EDGES}], lambda x: CAST(count(*) - count(g) AS DOUBLE) / CAST(count(*) AS DOUBLE) >= x)) AS w FROM sparse GROUP BY sample_ord) ON w = b GROUP BY b"""),
    "variant_set_sha256": _q("SELECT sha256(string_agg(chrom || chr(9) || pos || chr(9) || ref || chr(9) || alt || chr(10), '' ORDER BY chrom, pos, ref, alt)) AS sha, count(*) AS n_hashed, (SELECT count(*) FROM raw) AS n_raw FROM a"),
    "duplicate_keys": _q("SELECT id, count(*) AS n FROM a GROUP BY id HAVING count(*) > 1"),
}
