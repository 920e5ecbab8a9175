"""The same results as plain SQL, for a second engine to check. Written without the library's
search structures: neighbours are found by brute force, ranks by whole-table windows."""

from __future__ import annotations

import re

from assayframe import schemas as S
from assayframe.plans import queries as Q

VIEWS: dict[str, str] = {
    "mol": """
SELECT p_partkey AS mol_id,
  CASE p_type
    WHEN 'STANDARD' THEN concat(repeat('C', p_size), 'OS(=O)(=O)[O-].[Na+]')
    WHEN 'ECONOMY'  THEN concat(repeat('C', p_size), '[N+](C)(C)C.[Br-]')
    WHEN 'MEDIUM'   THEN concat(repeat('C', p_size), '[N+](C)(C)CC(=O)[O-]')
    WHEN 'SMALL'    THEN concat(repeat('C', p_size), 'OCCOCCO')
    WHEN 'LARGE'    THEN concat(repeat('C', p_size), 'C(=O)[O-].[K+]')
    ELSE                 concat('[Br-].', repeat('C', p_size), '[n+]1ccccc1')
  END AS smiles,
  CASE p_type WHEN 'STANDARD' THEN '[Na+]' WHEN 'ECONOMY' THEN '[Br-]' WHEN 'LARGE' THEN '[K+]'
              WHEN 'PROMO' THEN '[Br-]' ELSE CAST(NULL AS VARCHAR) END AS counterion,
  CASE WHEN p_size % 13 = 0 THEN CAST(NULL AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS tail_raw,
  CASE WHEN p_partkey % 50 = 1 THEN CAST(NULL AS VARCHAR) ELSE lower(p_type) END AS surfactant_type,
  p_retailprice AS molecular_weight
FROM part""",
    "meas_raw": """
SELECT concat(CAST(l_orderkey AS VARCHAR), '|', CAST(l_partkey AS VARCHAR), '|',
              CAST(l_suppkey AS VARCHAR), '|', CAST(l_linenumber AS VARCHAR), '|',
              CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS sample_id,
  l_linenumber AS line_no, m.mol_id AS mol_id, m.smiles AS smiles, m.counterion AS counterion,
  m.tail_raw AS tail_raw, m.surfactant_type AS surfactant_type, m.molecular_weight AS molecular_weight,
  CASE WHEN l_tax = 0.08 THEN 'UNK'
       WHEN l_tax = 0.07 THEN concat(CAST(20 + 5 * (CAST(l_quantity AS INT) % 8) AS VARCHAR), ',5')
       ELSE CAST(20 + 5 * (CAST(l_quantity AS INT) % 8) AS VARCHAR) END AS temp_raw,
  CASE l_returnflag WHEN 'N' THEN CAST(NULL AS VARCHAR) WHEN 'A' THEN '[Na+].[Cl-]' ELSE '' END AS additive_raw,
  CASE WHEN l_returnflag <> 'A' THEN CAST(NULL AS VARCHAR)
       WHEN l_discount = 0.0 THEN 'UNK'
       ELSE CAST(l_discount AS VARCHAR) END AS conc_raw,
  CASE WHEN l_suppkey % 20 = 0 THEN CAST(NULL AS DOUBLE) ELSE log10(l_extendedprice) END AS pcmc,
  CASE WHEN l_suppkey % 20 = 0 THEN CAST(NULL AS DOUBLE) ELSE 1 / l_extendedprice END AS cmc
FROM lineitem JOIN mol m ON m.mol_id = l_partkey""",
    "meas": """
SELECT sample_id, mol_id, smiles AS surfactant_smiles,
  TRY_CAST(replace(temp_raw, ',', '.') AS DOUBLE) AS temperature,
  NULLIF(trim(additive_raw), '') AS additive_smiles,
  TRY_CAST(replace(conc_raw, ',', '.') AS DOUBLE) AS additive_concentration,
  pcmc
FROM meas_raw WHERE line_no >= 4""",
    "paper1": """
SELECT smiles, TRY_CAST(replace(temp_raw, ',', '.') AS DOUBLE) AS T, pcmc AS pCMC
FROM meas_raw WHERE line_no = 1 AND pcmc IS NOT NULL AND temp_raw <> 'UNK'""",
    "paper4": """
SELECT smiles AS String, 6.0 - pcmc AS log_cmc_um, TRY_CAST(replace(temp_raw, ',', '.') AS DOUBLE) AS T_C
FROM meas_raw WHERE line_no = 2 AND pcmc IS NOT NULL AND temp_raw <> 'UNK'""",
    "lab": """
SELECT sample_id, mol_id,
  CASE WHEN mol_id % 10 = 0 THEN concat('CC(C)', smiles) ELSE smiles END AS surfactant_smiles,
  TRY_CAST(replace(temp_raw, ',', '.') AS DOUBLE) AS temperature,
  CASE WHEN additive_raw = '' THEN '[Mg+2].[Cl-].[Cl-]' ELSE additive_raw END AS additive_smiles,
  CASE WHEN additive_raw = '' THEN CAST(0.01 AS DOUBLE) ELSE TRY_CAST(conc_raw AS DOUBLE) END AS additive_concentration,
  pcmc
FROM meas_raw WHERE line_no = 3 AND pcmc IS NOT NULL AND temp_raw <> 'UNK'""",
    "lab_ok": "SELECT * FROM lab WHERE NOT (additive_smiles IS NOT NULL AND additive_concentration IS NULL)",
    "descr": "SELECT vec_id AS mol_id, CAST(embedding AS DOUBLE[]) AS fp FROM embeddings",
    "predlog": """
SELECT event_id AS id, ts, user_id AS input_key, round(value / 100, 4) AS predicted_pcmc,
  CASE event_type WHEN 'view' THEN 'Good' WHEN 'click' THEN 'Overestimated'
       WHEN 'purchase' THEN 'Underestimated' WHEN 'error' THEN 'Bad' ELSE '' END AS feedback
FROM events""",
    "parsed": """
SELECT sample_id, smiles AS surfactant_smiles, counterion,
  CASE WHEN trim(additive_raw) <> '' THEN additive_raw END AS additive_smiles,
  TRY_CAST(replace(NULLIF(conc_raw, 'UNK'), ',', '.') AS DOUBLE) AS additive_concentration,
  TRY_CAST(replace(NULLIF(temp_raw, 'UNK'), ',', '.') AS DOUBLE) AS temperature,
  CAST(tail_raw AS SMALLINT) AS tail_c_number, surfactant_type, molecular_weight, cmc, pcmc
FROM meas_raw
WHERE line_no >= 4 AND tail_raw IS NOT NULL AND molecular_weight IS NOT NULL AND surfactant_type IS NOT NULL""",
    "cleaned": """
SELECT * REPLACE (coalesce(temperature, (SELECT round(avg(temperature), 6) FROM parsed)) AS temperature)
FROM parsed WHERE NOT (additive_smiles IS NOT NULL AND additive_concentration IS NULL)""",
    "replicates": """
SELECT surfactant_smiles, counterion, additive_smiles, additive_concentration, temperature,
  arg_min(tail_c_number, sample_id) FILTER (tail_c_number IS NOT NULL) AS tail_c_number,
  arg_min(surfactant_type, sample_id) FILTER (surfactant_type IS NOT NULL) AS surfactant_type,
  arg_min(molecular_weight, sample_id) FILTER (molecular_weight IS NOT NULL) AS molecular_weight,
  avg(cmc) AS cmc, coalesce(stddev_samp(cmc), 0.0) AS cmc_std,
  avg(pcmc) AS pcmc, coalesce(stddev_samp(pcmc), 0.0) AS pcmc_std,
  split_part(surfactant_smiles, '.', 1) AS smiles_no_counterion
FROM cleaned GROUP BY ALL""",
    "expert": "SELECT surfactant_smiles, temperature, additive_smiles, additive_concentration, pcmc FROM replicates",
    "papers": """
SELECT smiles AS surfactant_smiles, T AS temperature, CAST(NULL AS VARCHAR) AS additive_smiles,
  CAST(NULL AS DOUBLE) AS additive_concentration, pCMC AS pcmc FROM paper1
UNION ALL SELECT String, T_C, NULL, NULL, 6.0 - log_cmc_um FROM paper4""",
    "everything": """
SELECT surfactant_smiles, temperature, additive_smiles, additive_concentration, avg(pcmc) AS pcmc
FROM (SELECT * FROM expert UNION ALL SELECT * FROM papers)
GROUP BY 1, 2, 3, 4""",
    "merged": """
SELECT *, concat_ws('|', surfactant_smiles, CAST(CAST(temperature AS DECIMAL(18,6)) AS VARCHAR),
  coalesce(additive_smiles, '-'),
  coalesce(CAST(CAST(additive_concentration AS DECIMAL(18,6)) AS VARCHAR), '-')) AS sample_id
FROM everything""",
    "known": "SELECT * FROM merged WHERE pcmc IS NOT NULL",
    "drop_policy": """
SELECT * FROM (
  SELECT smiles AS surfactant_smiles,
    TRY_CAST(replace(NULLIF(temp_raw, 'UNK'), ',', '.') AS DOUBLE) AS temperature,
    CASE WHEN trim(additive_raw) <> '' THEN additive_raw END AS additive_smiles,
    TRY_CAST(replace(NULLIF(conc_raw, 'UNK'), ',', '.') AS DOUBLE) AS additive_concentration, pcmc
  FROM meas_raw WHERE line_no >= 4)
WHERE pcmc IS NOT NULL AND temperature IS NOT NULL""",
    "lab_scored": "SELECT *, (SELECT avg(pcmc) FROM meas) AS predicted_pcmc FROM lab_ok",
    "profiles": "SELECT DISTINCT surfactant_smiles, additive_smiles, additive_concentration FROM lab_ok",
    "binned": """
SELECT k.*, greatest(0, len(list_filter(e.edges, lambda x: x < round(k.pcmc, 9))) - 1)::INT AS bin
FROM known k, (
  SELECT list_distinct(list_transform(
    [min(pcmc), quantile_cont(pcmc, 0.25), quantile_cont(pcmc, 0.5), quantile_cont(pcmc, 0.75), max(pcmc)],
    lambda x: round(x, 9))) AS edges FROM known) e""",
    "folded": """
SELECT *, CAST((row_number() OVER (PARTITION BY bin ORDER BY md5(concat('42|', sample_id)), sample_id) - 1 + bin) % 5 AS INT) AS fold
FROM binned""",
    "nested": """
SELECT * EXCLUDE (rn, n_total), CASE WHEN rn < floor(n_total * CAST(0.2 AS DOUBLE)) THEN 'val' ELSE 'train' END AS part
FROM (
  SELECT f.*, o.outer_fold,
    row_number() OVER (PARTITION BY o.outer_fold, f.bin
      ORDER BY md5(concat(CAST(43 + o.outer_fold AS VARCHAR), '|', f.sample_id)), f.sample_id) - 1 AS rn,
    count(*) OVER (PARTITION BY o.outer_fold, f.bin) AS n_total
  FROM folded f JOIN (SELECT CAST(unnest(range(5)) AS INT) AS outer_fold) o ON o.outer_fold <> f.fold)""",
    "cv_mean": """
SELECT m.fold, g.train_mae, g.train_r2, g.test_mae, g.test_r2
FROM (SELECT o.fold, avg(f.pcmc) FILTER (f.fold <> o.fold) AS p FROM folded f, (SELECT DISTINCT fold FROM folded) o GROUP BY 1) m,
LATERAL (
  SELECT avg(abs(pcmc - m.p)) FILTER (fold <> m.fold) AS train_mae,
    1 - avg((pcmc - m.p) ** 2) FILTER (fold <> m.fold) / var_pop(pcmc) FILTER (fold <> m.fold) AS train_r2,
    avg(abs(pcmc - m.p)) FILTER (fold = m.fold) AS test_mae,
    1 - avg((pcmc - m.p) ** 2) FILTER (fold = m.fold) / var_pop(pcmc) FILTER (fold = m.fold) AS test_r2
  FROM folded) g""",
    "described": "SELECT m.*, d.fp FROM meas m JOIN descr d USING (mol_id)",
    "roles": """
SELECT m.*, CASE WHEN m.additive_smiles IS NOT NULL THEN m.mol_id % 97 END AS additive_mol_id,
  a.fp AS fp_all, b.fp AS fp_additive
FROM meas m JOIN descr a ON a.mol_id = m.mol_id
LEFT JOIN descr b ON b.mol_id = CASE WHEN m.additive_smiles IS NOT NULL THEN m.mol_id % 97 END""",
    "pool": """
SELECT 'train' AS side, sample_id, surfactant_smiles, temperature, additive_smiles, additive_concentration, pcmc FROM known
UNION ALL SELECT 'test', sample_id, surfactant_smiles, temperature, additive_smiles, additive_concentration, pcmc FROM lab_ok""",
}

CLASS = """CASE WHEN contains(lower({c}), '[o-]') AND regexp_matches(lower({c}), '\\[n(h|h2|h3)?\\+\\]') THEN 'zwitterionic'
  WHEN contains(lower({c}), '[o-]') THEN 'anionic'
  WHEN regexp_matches(lower({c}), '\\[n(h|h2|h3)?\\+\\]') THEN 'cationic' ELSE 'nonionic' END"""


def subject_class(c: str = "surfactant_smiles") -> str:
    return CLASS.format(c=c)


def r6(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0"


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the views that ``body`` names, directly or through others, in front of it."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", sql):
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(body)
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" + body if order else body


METRIC_COLUMNS = f"""CAST(count(*) AS BIGINT) AS n, {r6('avg(abs(pcmc - predicted_pcmc))')} AS mae,
  {r6('avg((pcmc - predicted_pcmc) ** 2)')} AS mse, {r6('sqrt(avg((pcmc - predicted_pcmc) ** 2))')} AS rmse,
  {r6('1 - avg((pcmc - predicted_pcmc) ** 2) / var_pop(pcmc)')} AS r2"""


def carbons(c: str = "surfactant_smiles") -> str:
    return f"length({c}) - length(replace({c}, 'C', ''))"


def knn_views(train: str, asked: str, *, by: str | None = None, k: int = 5, prefix: str = "") -> dict[str, str]:
    """Brute-force neighbour regression. ``asked`` rows come back as ``{prefix}scored``."""
    g = f"{by}, " if by else ""
    on = f"q.{by} = t.{by}" if by else "TRUE"
    same = f"AND s.{by} = q.{by}" if by else ""
    feats = f"""CAST({carbons()} AS DOUBLE) AS carbons, temperature AS temp, coalesce(additive_smiles, '') AS additive,
      additive_concentration AS conc"""
    p = prefix
    return {
        f"{p}base": f"SELECT {g}sample_id AS row_id, pcmc AS y, {feats} FROM {train}",
        f"{p}ask": f"SELECT *, {feats} FROM {asked}",
        f"{p}gaps": f"""SELECT DISTINCT {g}carbons, temp, additive FROM (
  SELECT {g}carbons, temp, additive, conc FROM {p}base UNION ALL SELECT {g}carbons, temp, additive, conc FROM {p}ask) u
WHERE conc IS NULL""",
        f"{p}donors": f"SELECT * FROM {p}base WHERE conc IS NOT NULL",
        f"{p}filled": f"""SELECT {g}carbons, temp, additive, round(list_avg(near), 6) AS filled FROM (
  SELECT {f'q.{by},' if by else ''} q.carbons, q.temp, q.additive, arg_min(t.conc, struct_pack(
    d := round((q.carbons - t.carbons) ** 2 + (q.temp - t.temp) ** 2, 9) + CASE WHEN q.additive = t.additive THEN 0 ELSE 2 END,
    id := t.row_id), {k}) AS near
  FROM {p}gaps q JOIN {p}donors t ON {on} GROUP BY ALL)""",
        f"{p}train": f"SELECT b.* REPLACE (coalesce(b.conc, f.filled, 0.0) AS conc) FROM {p}base b LEFT JOIN {p}filled f USING ({g}carbons, temp, additive)",
        f"{p}wanted": f"SELECT a.* REPLACE (coalesce(a.conc, f.filled, 0.0) AS conc) FROM {p}ask a LEFT JOIN {p}filled f USING ({g}carbons, temp, additive)",
        f"{p}points": f"""SELECT q.*, s.additive IS NOT NULL AS seen FROM (SELECT DISTINCT {g}carbons, temp, additive, conc FROM {p}wanted) q
LEFT JOIN (SELECT DISTINCT {g}additive FROM {p}train) s ON s.additive = q.additive {same}""",
        f"{p}answers": f"""SELECT {g}carbons, temp, additive, conc, list_avg(near) AS predicted_pcmc FROM (
  SELECT {f'q.{by},' if by else ''} q.carbons, q.temp, q.additive, q.conc, arg_min(t.y, struct_pack(
    d := round(round((q.carbons - t.carbons) * (q.carbons - t.carbons) + (q.temp - t.temp) * (q.temp - t.temp)
                     + (q.conc - t.conc) * (q.conc - t.conc), 9)
      + CASE WHEN NOT q.seen THEN 1.0 WHEN q.additive = t.additive THEN 0.0 ELSE 2.0 END, 9),
    id := t.row_id), {k}) AS near
  FROM {p}points q JOIN {p}train t ON {on} GROUP BY ALL)""",
        f"{p}scored": f"SELECT f.*, a.predicted_pcmc FROM {p}wanted f JOIN {p}answers a USING ({g}carbons, temp, additive, conc)",
    }


def values(name: str, numbers) -> str:
    pairs = ", ".join(f"({i}, CAST({v!r} AS DOUBLE))" for i, v in enumerate(numbers))
    return f"(VALUES {pairs}) AS {name}(step, temperature)"


CANON = "surfactant_smiles, temperature, additive_smiles, additive_concentration, " + r6("pcmc") + " AS pcmc"
COND = "surfactant_smiles, temperature, additive_smiles, additive_concentration"


def _vector_sum(v: str) -> str:
    return r6(f"list_sum({v})")


def _ranked(source: str, fraction: str, rounding: str) -> str:
    return f"""SELECT sample_id, CASE WHEN rn < {rounding}(n * CAST({fraction} AS DOUBLE)) THEN 'test' ELSE 'train' END AS split
FROM (SELECT sample_id, row_number() OVER (ORDER BY md5(concat('42|', sample_id)), sample_id) - 1 AS rn, count(*) OVER () AS n
      FROM {source} WHERE pcmc IS NOT NULL)"""


def _standard() -> str:
    columns = {"temperature": "temperature", "additive_concentration": "additive_concentration", "carbons": f"CAST({carbons()} AS DOUBLE)"}
    columns |= {f"fp_{i}": f"fp[{i + 1}]" for i in range(Q.FP_WIDTH)}
    src = "SELECT sample_id, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM described"
    outs = []
    for n in columns:
        filled = f"coalesce({n}, avg({n}) OVER ())"
        std = f"sqrt(var_pop({n}) OVER () * count({n}) OVER () / count(*) OVER ())"
        outs.append(r6(f"({filled} - avg({n}) OVER ()) / CASE WHEN {std} > 0 THEN {std} ELSE 1 END") + f" AS {n}")
    return f"SELECT sample_id, {', '.join(outs)} FROM ({src})"


def _total_variance() -> str:
    """Each position's population variance with missing values at the mean, added up."""
    exprs = ["temperature", "additive_concentration", f"CAST({carbons()} AS DOUBLE)", *[f"fp[{i + 1}]" for i in range(Q.FP_WIDTH)]]
    part = lambda e: f"coalesce(var_pop({e}) * count({e}) / count(*), 0)"
    total = lambda some: " + ".join(part(e) for e in some)
    there = lambda some: " + ".join(f"(count({e}) > 0)::INT" for e in some)
    return with_views(" UNION ALL ".join(
        f"SELECT '{name}' AS features, CAST({there(some)} AS INT) AS n_features, round({total(some)}, 5) AS variance FROM described WHERE pcmc IS NOT NULL"
        for name, some in (("all", exprs), ("descriptors", exprs[3:]))))


def _csv_round_trip() -> str:
    null = "CAST(NULL AS VARCHAR)"
    nothing = "NULL, NULL, NULL, NULL, NULL"
    return with_views(f"""SELECT rejected, surfactant_smiles, temperature, additive_smiles, additive_concentration, {r6('pcmc')} AS pcmc, count(*) AS n_rows FROM (
SELECT {null} AS rejected, surfactant_smiles, temperature, additive_smiles, additive_concentration, pcmc FROM lab
WHERE mol_id % 3 = 0 OR (mol_id % 3 = 1 AND mol_id % 7 <> 0)
UNION ALL SELECT {null}, surfactant_smiles, temperature, NULL, NULL, pcmc FROM lab WHERE mol_id % 3 = 2 AND mol_id % 7 <> 0 AND mol_id % 11 <> 0
UNION ALL SELECT 'malformed', {nothing} FROM lab WHERE mol_id % 3 <> 0 AND mol_id % 7 = 0
UNION ALL SELECT 'incomplete', {nothing} FROM lab WHERE mol_id % 3 = 2 AND mol_id % 7 <> 0 AND mol_id % 11 = 0)
GROUP BY ALL""")


def _load_violations() -> str:
    checks = {"n_rows": "true", "subject_not_null": "surfactant_smiles IS NULL", "temperature_not_null": "temperature IS NULL",
              "concentration_with_additive": "additive_smiles IS NOT NULL AND additive_concentration IS NULL", "target_not_null": "pcmc IS NULL"}
    sources = {"expert": "expert", "everything": "everything", "lab": "lab",
               "paper1": "(SELECT * FROM papers_1)", "paper4": "(SELECT * FROM papers_4)"}
    extra = {"papers_1": VIEWS["papers"].split("UNION ALL")[0],
             "papers_4": """SELECT String AS surfactant_smiles, T_C AS temperature, CAST(NULL AS VARCHAR) AS additive_smiles,
  CAST(NULL AS DOUBLE) AS additive_concentration, 6.0 - log_cmc_um AS pcmc FROM paper4"""}
    return with_views(" UNION ALL ".join(
        f"SELECT '{source}' AS source, '{rule}' AS rule, count(*) FILTER ({bad}) AS n FROM {table}"
        for source, table in sources.items() for rule, bad in checks.items()), extra)


def _impute() -> str:
    outs = [r6(f"coalesce({c}, avg({c}) OVER ())") + f" AS {c}" for c in Q.IMPUTED]
    return f"SELECT sample_id, {', '.join(outs)} FROM meas"


def _cv_knn() -> str:
    extra: dict[str, str] = {
        "inner_train": "SELECT n.*, outer_fold AS model_fold FROM nested n WHERE part = 'train'",
        "inner_val": "SELECT n.*, outer_fold AS model_fold FROM nested n WHERE part = 'val'",
        "outer_all": """SELECT f.*, o.model_fold, CASE WHEN f.fold = o.model_fold THEN 'test' ELSE 'train' END AS side
FROM folded f, (SELECT CAST(unnest(range(5)) AS INT) AS model_fold) o""",
        "outer_train": "SELECT * FROM outer_all WHERE side = 'train'",
    }
    errors = []
    for i, k in enumerate(Q.KNN_GRID):
        extra |= knn_views("inner_train", "inner_val", by="model_fold", k=k, prefix=f"v{i}_")
        errors.append(f"SELECT model_fold, {i} AS candidate, avg(abs(pcmc - predicted_pcmc)) AS mae FROM v{i}_scored GROUP BY 1")
    extra["best"] = "SELECT model_fold, arg_min(candidate, struct_pack(m := mae, c := candidate)) AS best FROM (" + " UNION ALL ".join(errors) + ") GROUP BY 1"
    parts = []
    for i, k in enumerate(Q.KNN_GRID):
        extra[f"o{i}_in"] = f"SELECT o.* FROM outer_all o JOIN best b USING (model_fold) WHERE b.best = {i}"
        extra[f"o{i}_tr"] = f"SELECT * FROM o{i}_in WHERE side = 'train'"
        extra |= knn_views(f"o{i}_tr", f"o{i}_in", by="model_fold", k=k, prefix=f"o{i}_")
        parts.append(f"SELECT model_fold, side, pcmc, predicted_pcmc, {k} AS k FROM o{i}_scored")
    mae, r2 = "avg(abs(pcmc - predicted_pcmc))", "1 - avg((pcmc - predicted_pcmc) ** 2) / var_pop(pcmc)"
    per = f"SELECT model_fold, side, min(k) AS k, {mae} AS mae, {r2} AS r2 FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2"
    r2 = r2.replace("var_pop(pcmc)", "var_pop(pcmc)")
    return with_views(f"""SELECT model_fold AS fold, CAST(min(k) AS INT) AS k,
  {r6("max(CASE WHEN side = 'train' THEN mae END)")} AS train_mae, {r6("max(CASE WHEN side = 'train' THEN r2 END)")} AS train_r2,
  {r6("max(CASE WHEN side = 'test' THEN mae END)")} AS test_mae, {r6("max(CASE WHEN side = 'test' THEN r2 END)")} AS test_r2
FROM ({per}) GROUP BY 1""", extra)


def _experiment() -> str:
    rows = f"""
SELECT side, pcmc, CAST({Q.DUMMY_VALUE} AS DOUBLE) AS predicted_pcmc, 'constant' AS model, 'value={Q.DUMMY_VALUE}' AS params FROM pool
UNION ALL SELECT side, pcmc, (SELECT avg(pcmc) FROM known), 'mean', '' FROM pool
UNION ALL SELECT side, pcmc, predicted_pcmc, 'knn', 'k=5' FROM scored"""
    mae = "avg(abs(pcmc - predicted_pcmc)) FILTER (side = '{s}')"
    r2 = "1 - avg((pcmc - predicted_pcmc) ** 2) FILTER (side = '{s}') / var_pop(pcmc) FILTER (side = '{s}')"
    return with_views(f"""SELECT 'none' AS features, model, params, 'everything' AS train_set,
  {r6(mae.format(s='train'))} AS train_mae, {r6(r2.format(s='train'))} AS train_r2, 'lab' AS test_set,
  {r6(mae.format(s='test'))} AS test_mae, {r6(r2.format(s='test'))} AS test_r2
FROM ({rows}) GROUP BY model, params""", knn_views("known", "pool"))


def _ablation() -> str:
    extra: dict[str, str] = {
        "kept_none": "SELECT sample_id, surfactant_smiles, pcmc FROM known",
        "kept_expert": "SELECT sample_id, surfactant_smiles, pcmc FROM known",
        "kept_descr": """SELECT sample_id, surfactant_smiles, pcmc FROM known
WHERE surfactant_smiles IN (SELECT smiles FROM mol JOIN descr USING (mol_id))""",
    }
    parts = []
    for s in ("none", "expert", "descr"):
        extra[f"binned_{s}"] = VIEWS["binned"].replace("FROM known k", f"FROM kept_{s} k").replace("FROM known)", f"FROM kept_{s})")
        extra[f"folded_{s}"] = VIEWS["folded"].replace("FROM binned", f"FROM binned_{s}")
        extra[f"cv_{s}"] = VIEWS["cv_mean"].replace("FROM folded", f"FROM folded_{s}")
        extra[f"flat_{s}"] = f"""SELECT fold, avg(abs(pcmc - {Q.DUMMY_VALUE})) AS test_mae,
  1 - avg((pcmc - {Q.DUMMY_VALUE}) ** 2) / var_pop(pcmc) AS test_r2 FROM folded_{s} GROUP BY 1"""
        for model, view in (("mean", f"cv_{s}"), ("constant", f"flat_{s}")):
            parts.append(f"""SELECT '{s}' AS features, '{model}' AS model, {r6('avg(test_mae)')} AS test_mae_mean,
  {r6('stddev_pop(test_mae)')} AS test_mae_std, {r6('avg(test_r2)')} AS test_r2_mean, {r6('stddev_pop(test_r2)')} AS test_r2_std FROM {view}""")
    return with_views("\nUNION ALL\n".join(parts), extra)


def _grams(source: str, key: str, column: str) -> str:
    return f"""SELECT {key}, CAST(CAST(concat('0x', substr(md5(gram), 1, 8)) AS BIGINT) % 256 AS INT) AS bucket, count(*) AS n
FROM (SELECT {key}, unnest(list_transform(range(1, len(ch) - 2), lambda i: concat(ch[i], ch[i + 1], ch[i + 2], ch[i + 3]))) AS gram
      FROM (SELECT {key}, string_split({column}, '') AS ch FROM {source}))
GROUP BY 1, 2"""


ENTRY_VIEWS: dict[str, str] = {
    "weight_of": "SELECT smiles AS key, arg_min(molecular_weight, mol_id) AS w FROM mol GROUP BY 1",
    "vector_of": f"""
SELECT smiles AS key, arg_min(fp, mol_id) AS v FROM mol JOIN descr USING (mol_id) GROUP BY 1
UNION ALL SELECT '{Q.KNOWN_ADDITIVE}', arg_min(fp, mol_id) FROM mol JOIN descr USING (mol_id)""",
    "set_conditions": """
SELECT sample_id, 'temperature' AS feature, temperature AS value FROM lab
UNION ALL SELECT sample_id, 'concentration', additive_concentration FROM lab
UNION ALL SELECT sample_id, 'concentration_mask', 1.0 FROM lab WHERE additive_concentration IS NOT NULL
UNION ALL SELECT sample_id, 'additive_mask', 1.0 FROM lab WHERE trim(additive_smiles) <> ''""",
}


def _entries(body: str) -> str:
    return with_views(f"""SELECT sample_id, feature, {r6('value')} AS value FROM (
SELECT * FROM set_conditions
{body}) WHERE value <> 0""", ENTRY_VIEWS)


def _expert_lingo() -> str:
    tail = "length(regexp_extract(surfactant_smiles, '^(C+)', 1))"
    grams = " ".join(f"""
UNION ALL SELECT sample_id, concat('lingo_{role}_', CAST(bucket AS VARCHAR)), n FROM ({_grams('lab', 'sample_id', column)})"""
                     for role, column in (("all", "surfactant_smiles"), ("additive", "additive_smiles")))
    return _entries(f"""UNION ALL SELECT sample_id, 'tail_c_number', {tail} FROM lab
UNION ALL SELECT sample_id, concat('type_', {subject_class()}), 1.0 FROM lab
UNION ALL SELECT sample_id, 'molecular_weight', w FROM lab JOIN weight_of ON key = surfactant_smiles
UNION ALL SELECT sample_id, 'molecular_weight_mask', 1.0 FROM lab JOIN weight_of ON key = surfactant_smiles{grams}""")


def _descr_chen() -> str:
    """Rows without a vector of the subject have no entries at all, as the inner join drops them."""
    having = "lab JOIN vector_of a ON a.key = surfactant_smiles"
    return with_views(f"""SELECT sample_id, feature, {r6('value')} AS value FROM (
SELECT c.* FROM set_conditions c JOIN {having} USING (sample_id)
UNION ALL SELECT sample_id, concat('descr_all_', CAST(i AS VARCHAR)), v[i + 1] FROM {having}, range(64) t(i)
UNION ALL SELECT sample_id, concat('descr_additive_', CAST(i AS VARCHAR)), b.v[i + 1] FROM {having} JOIN vector_of b ON b.key = additive_smiles, range(64) t(i)
UNION ALL SELECT sample_id, 'descr_additive_mask', 1.0 FROM {having} JOIN vector_of b ON b.key = additive_smiles
UNION ALL SELECT sample_id, concat('chen_all_', CAST(i AS VARCHAR)), v[i + 1] FROM {having}, range(19) t(i)) WHERE value <> 0""", ENTRY_VIEWS)


def _train_test_modes() -> str:
    rows = """
SELECT 'split' AS mode, split AS side, k.pcmc, (SELECT avg(x.pcmc) FROM known x JOIN cut y USING (sample_id) WHERE y.split = 'train') AS p
FROM known k JOIN cut USING (sample_id)
UNION ALL SELECT 'two', side, pcmc, (SELECT avg(pcmc) FROM known) FROM pool
UNION ALL SELECT 'saved', 'test', pcmc, (SELECT avg(pcmc) FROM known) FROM lab_ok"""
    return with_views(f"""SELECT mode, side, count(*) AS n, {r6('avg(abs(pcmc - p))')} AS mae, {r6('avg((pcmc - p) ** 2)')} AS mse,
  {r6('sqrt(avg((pcmc - p) ** 2))')} AS rmse, {r6('1 - avg((pcmc - p) ** 2) / var_pop(pcmc)')} AS r2 FROM ({rows}) GROUP BY 1, 2""",
                      {"cut": _ranked("known", "0.2", "floor")})


def build() -> dict[str, str]:
    cls = subject_class()
    grid = " UNION ALL ".join(
        f"SELECT {i} AS candidate, CAST({v} AS DOUBLE) AS value" for i, v in enumerate(Q.CONSTANT_GRID))
    parse = "TRY_CAST(NULLIF({c}, 'UNK') AS DOUBLE)"
    comma = "TRY_CAST(replace(NULLIF({c}, 'UNK'), ',', '.') AS DOUBLE)"
    facts = "tail_raw IS NULL OR molecular_weight IS NULL OR surfactant_type IS NULL"
    short = f"trim(additive_raw) <> '' AND {comma.format(c='conc_raw')} IS NULL"
    hot = {level: f"CASE WHEN cls = '{level}' THEN 1 ELSE 0 END AS type_{level}" for level in S.SUBJECT_CLASSES}
    plain: dict[str, str] = {
        "scan_lab": f"SELECT sample_id, {CANON} FROM lab",
        "conform_paper1": f"SELECT {CANON} FROM papers1",
        "conform_paper4": f"SELECT {CANON} FROM papers4",
        "conform_expert": f"SELECT {CANON} FROM expert",
        "conform_drop_policy": f"SELECT {CANON} FROM drop_policy",
        "flatten_samples": f"""SELECT surfactant_smiles, temperature, additive_smiles,
  CASE WHEN additive_smiles IS NOT NULL THEN additive_concentration END AS additive_concentration FROM lab""",
        "canonical_projection": f"SELECT {CANON} FROM meas",
        "clean_sentinel_numeric": f"SELECT sample_id, {parse.format(c='temp_raw')} AS temperature, {parse.format(c='conc_raw')} AS concentration FROM meas_raw",
        "clean_decimal_comma": f"SELECT sample_id, {comma.format(c='temp_raw')} AS temperature, {comma.format(c='conc_raw')} AS concentration FROM meas_raw",
        "clean_blank_to_null": "SELECT sample_id, CASE WHEN trim(additive_raw) <> '' THEN additive_raw END AS additive_smiles FROM meas_raw",
        "drop_null_subset": f"SELECT sample_id, tail_raw, molecular_weight, surfactant_type FROM meas_raw WHERE NOT ({facts})",
        "drop_incomplete_additive": "SELECT sample_id, additive_smiles, additive_concentration FROM meas WHERE additive_smiles IS NULL OR additive_concentration IS NOT NULL",
        "fill_global_mean": "SELECT sample_id, coalesce(temperature, (SELECT round(avg(temperature), 6) FROM meas)) AS temperature FROM meas",
        "fill_constant": "SELECT sample_id, coalesce(temperature, 25.0) AS temperature FROM meas",
        "clean_infinities": f"""SELECT sample_id,
  CASE WHEN mol_id % 7 IN (0, 1) THEN 0.0 WHEN mol_id % 7 = 2 THEN NULL ELSE {r6('pcmc')} END AS as_zero,
  CASE WHEN mol_id % 7 > 2 THEN {r6('pcmc')} END AS as_null FROM meas""",
        "cleaning_funnel": f"""SELECT CAST(step AS INT) AS step, rule, CAST(n_rows AS BIGINT) AS n_rows FROM (
  SELECT 0 AS step, 'rows_in' AS rule, count(*) AS n_rows FROM meas_raw WHERE line_no >= 4
  UNION ALL SELECT 1, 'dropped_missing_facts', count(*) FROM meas_raw WHERE line_no >= 4 AND ({facts})
  UNION ALL SELECT 2, 'filled_temperature', count(*) FROM parsed WHERE temperature IS NULL
  UNION ALL SELECT 3, 'dropped_incomplete_additive', count(*) FROM meas_raw WHERE line_no >= 4 AND NOT ({facts}) AND {short}
  UNION ALL SELECT 4, 'rows_out', count(*) FROM cleaned)""",
        "annotated_only": f"SELECT sample_id, {CANON} FROM meas WHERE pcmc IS NOT NULL",
        "missing_only": f"SELECT sample_id, {COND} FROM meas WHERE pcmc IS NULL",
        "schema_violations": """SELECT 'subject_not_null' AS rule, count(*) FILTER (surfactant_smiles IS NULL) AS n_violations FROM meas
UNION ALL SELECT 'temperature_not_null', count(*) FILTER (temperature IS NULL) FROM meas
UNION ALL SELECT 'concentration_with_additive', count(*) FILTER (additive_smiles IS NOT NULL AND additive_concentration IS NULL) FROM meas
UNION ALL SELECT 'target_not_null', count(*) FILTER (pcmc IS NULL) FROM meas""",
        "dedup_against_train": f"SELECT sample_id, {CANON} FROM lab l WHERE NOT EXISTS (SELECT 1 FROM meas m WHERE m.surfactant_smiles IS NOT DISTINCT FROM l.surfactant_smiles)",
        "leakage_report": """SELECT surfactant_smiles, count(*) AS n_rows FROM lab
WHERE surfactant_smiles IN (SELECT surfactant_smiles FROM meas) GROUP BY 1""",
        "attach_descriptors_inner": f"SELECT sample_id, mol_id, {r6('fp[1]')} AS fp_first, {r6('fp[64]')} AS fp_last, {_vector_sum('fp')} AS fp_sum FROM described",
        "attach_descriptors_two_role": "SELECT sample_id, mol_id, additive_mol_id, fp_additive IS NULL AS additive_absent, " + ", ".join(
            f"{r6(f'{c}[{i + 1}]')} AS {c}_{i}" for c in ("fp_all", "fp_additive") for i in range(Q.FP_WIDTH)) + " FROM roles",
        "features_by_distinct_key": f"""SELECT sample_id, surfactant_smiles, CAST(length(regexp_extract(surfactant_smiles, '^(C+)', 1)) AS INT) AS tail_c_number,
  CAST({carbons()} AS INT) AS carbons, {cls} AS surfactant_class FROM meas""",
        "profile_grid": f"SELECT p.*, CAST(v.step AS INT) AS step, v.temperature FROM profiles p, {values('v', Q.PROFILE_TEMPERATURES)}",
        "observed_points_nullsafe": f"""SELECT a.surfactant_smiles, a.additive_smiles, e.temperature AS observed_temperature, {r6('e.pcmc')} AS observed_pcmc
FROM (SELECT DISTINCT surfactant_smiles, additive_smiles FROM lab_ok) a JOIN everything e
  ON e.surfactant_smiles = a.surfactant_smiles AND e.additive_smiles IS NOT DISTINCT FROM a.additive_smiles""",
        "merge_mean": f"""SELECT surfactant_smiles, temperature, additive_smiles, additive_concentration, {r6('avg(pcmc)')} AS pcmc
FROM (SELECT * FROM papers UNION ALL SELECT {COND}, pcmc FROM lab) GROUP BY 1, 2, 3, 4""",
        "aggregate_replicates": f"""SELECT * REPLACE (CAST(tail_c_number AS INT) AS tail_c_number, round(cmc, 12) + 0.0 AS cmc, round(cmc_std, 12) + 0.0 AS cmc_std,
  {r6('pcmc')} AS pcmc, {r6('pcmc_std')} AS pcmc_std) FROM replicates""",
        "aggregate_targets": f"""SELECT surfactant_smiles, temperature, round(avg(cmc), 12) + 0.0 AS cmc, {r6('avg(pcmc)')} AS pcmc,
  arg_min(additive_smiles, sample_id) FILTER (additive_smiles IS NOT NULL) AS additive_smiles,
  arg_min(additive_concentration, sample_id) FILTER (additive_concentration IS NOT NULL) AS additive_concentration,
  arg_min(surfactant_type, sample_id) FILTER (surfactant_type IS NOT NULL) AS surfactant_type
FROM cleaned GROUP BY 1, 2""",
        "merged_everything": f"SELECT {CANON} FROM everything",
        "regression_metrics": f"SELECT {METRIC_COLUMNS} FROM lab_scored",
        "residuals_by_class": f"SELECT {cls} AS surfactant_class, {METRIC_COLUMNS} FROM lab_scored GROUP BY 1",
        "cv_summary": "SELECT " + ", ".join(
            f"{r6(f'avg({m})')} AS {m}_mean, {r6(f'stddev_pop({m})')} AS {m}_std" for m in Q.CV_METRICS) + " FROM cv_mean",
        "target_summary": "\nUNION ALL\n".join(
            f"""SELECT {cls} AS surfactant_class, count({c}) AS n, {r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max,
  {r6(f'avg({c})')} AS mean, {r6(f'stddev_pop({c})')} AS std, '{c}' AS measure FROM meas GROUP BY 1""" for c in ("pcmc", "temperature")),
        "fit_scalers": f"""SELECT {r6('avg(temperature)')} AS temp_mean, {r6('stddev_pop(temperature)')} AS temp_std,
  {r6('avg(additive_concentration)')} AS conc_mean, {r6('stddev_pop(additive_concentration)')} AS conc_std FROM meas WHERE pcmc IS NOT NULL""",
        "feature_covariance": f"""SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, {r6('covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b))')} AS cov
FROM (SELECT i, j, fp[i + 1] AS a, fp[j + 1] AS b FROM described, (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j) WHERE i <= j)
GROUP BY 1, 2""",
        "log_newest_first": "SELECT id, ts, input_key, predicted_pcmc, feedback FROM predlog ORDER BY ts DESC, id",
        "union_sources": f"SELECT {CANON} FROM (SELECT * FROM expert UNION ALL SELECT * FROM papers)",
        "union_selected_sources": f"""SELECT {CANON}, source FROM (SELECT *, 'expert' AS source FROM drop_policy
  UNION ALL SELECT smiles, T, NULL, NULL, pCMC, 'paper1' FROM paper1)""",
        "distinct_molecules": "SELECT DISTINCT surfactant_smiles FROM meas",
        "holdout_split": _ranked("meas", "0.2", "floor"),
        "holdout_split_ceil": _ranked("meas", "0.1", "ceil"),
        "kfold_assign": """SELECT sample_id, CAST((row_number() OVER (ORDER BY md5(concat('42|', sample_id)), sample_id) - 1) % 5 AS INT) AS fold
FROM meas WHERE pcmc IS NOT NULL""",
        "quantile_bins": "SELECT sample_id, bin FROM meas_binned",
        "stratified_kfold": "SELECT sample_id, bin, fold FROM folded",
        "nested_split": "SELECT sample_id, outer_fold, part FROM nested",
        "param_grid": """SELECT f.fold, f.n_rows, CAST(c.candidate AS INT) AS candidate, CAST(c.k AS INT) AS k, CAST(c.max_depth AS INT) AS max_depth
FROM (SELECT fold, count(*) AS n_rows FROM (
  SELECT CAST((row_number() OVER (ORDER BY md5(concat('42|', sample_id)), sample_id) - 1) % 5 AS INT) AS fold FROM meas WHERE pcmc IS NOT NULL) GROUP BY 1) f,
  (VALUES (0, 3, 8), (1, 3, 17), (2, 5, 8), (3, 5, 17), (4, 9, 8), (5, 9, 17)) AS c(candidate, k, max_depth)""",
        "select_best_candidate": f"""SELECT fold, CAST(arg_min(candidate, struct_pack(m := mae, c := candidate)) AS INT) AS best_candidate, min(mae) AS best_error
FROM (SELECT n.outer_fold AS fold, c.candidate, {r6('avg(abs(n.pcmc - c.value))')} AS mae
  FROM nested n, ({grid}) c WHERE n.part = 'val' GROUP BY 1, 2) GROUP BY 1""",
        "cv_mean_baseline": "SELECT fold, " + ", ".join(f"{r6(m)} AS {m}" for m in Q.CV_METRICS) + " FROM cv_mean",
        "leading_run_length": "SELECT mol_id, CAST(length(regexp_extract(smiles, '^(C+)', 1)) AS INT) AS tail_c_number FROM mol",
        "classify_by_substring": f"SELECT mol_id, {subject_class('smiles')} AS surfactant_class FROM mol",
        "strip_counterion": "SELECT mol_id, split_part(smiles, '.', 1) AS smiles_no_counterion FROM mol",
        "count_char": f"SELECT mol_id, CAST({carbons('smiles')} AS INT) AS carbons FROM mol",
        "unit_conversions": f"""SELECT sample_id, {r6('-log10(cmc)')} AS from_molar, {r6('pow(10.0, -pcmc) * 1e6')} AS micromolar,
  {r6('6.0 - log10(cmc * 1e6)')} AS from_log_micro FROM meas_raw WHERE cmc IS NOT NULL""",
        "format_prediction": "SELECT sample_id, round(pcmc, 4) AS predicted_pcmc, printf('%.6e', pow(10.0, -pcmc)) AS predicted_cmc_m FROM lab_ok",
        "presence_masks": f"""SELECT sample_id, CASE WHEN trim(additive_raw) <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS additive_mask,
  CASE WHEN {parse.format(c='conc_raw')} IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS conc_mask FROM meas_raw""",
        "scale_with_mask": f"""SELECT sample_id, {r6('(temperature - tm) / ts')} AS temp_scaled, {r6('coalesce((additive_concentration - cm) / cs, 0.0)')} AS conc_scaled,
  CASE WHEN additive_smiles IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS additive_mask,
  CASE WHEN additive_concentration IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS conc_mask
FROM lab, (SELECT avg(temperature) AS tm, stddev_pop(temperature) AS ts, avg(additive_concentration) AS cm,
  stddev_pop(additive_concentration) AS cs FROM meas WHERE pcmc IS NOT NULL) fit""",
        "gated_feature_vector": f"""SELECT sample_id, CAST(len(v) AS INT) AS width, {r6('v[1]')} AS first, {r6('v[65]')} AS temp, {r6('v[66]')} AS additive_first,
  {r6('v[130]')} AS conc, {_vector_sum('v')} AS total
FROM (SELECT sample_id, list_concat(list_concat(fp_all, [t]), list_concat(
    CASE WHEN fp_additive IS NULL THEN list_transform(range(64), lambda x: 0.0::DOUBLE) ELSE list_transform(fp_additive, lambda x: x * am) END,
    [c * cm, am, cm])) AS v
  FROM (SELECT r.*, coalesce((temperature - f.tm) / f.ts, 0.0) AS t, coalesce((additive_concentration - f.cm0) / f.cs, 0.0) AS c,
    CASE WHEN additive_smiles IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS am,
    CASE WHEN additive_concentration IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS cm
    FROM roles r, (SELECT avg(temperature) AS tm, stddev_pop(temperature) AS ts, avg(additive_concentration) AS cm0,
      stddev_pop(additive_concentration) AS cs FROM meas) f))""",
        "one_hot_fixed": f"""SELECT mol_id, {', '.join(hot.values())}, CASE WHEN cls IS NULL THEN 1 ELSE 0 END AS type_nan
FROM (SELECT mol_id, CASE WHEN mol_id % 50 <> 1 THEN {subject_class('smiles')} END AS cls FROM mol)""",
        "one_hot_learned": """SELECT l.sample_id, v.level_index, (SELECT count(DISTINCT coalesce(concat('=', additive_smiles), 'null')) FROM meas) AS n_levels
FROM lab l LEFT JOIN (SELECT level_key, row_number() OVER (ORDER BY md5(concat('42|', level_key)), level_key) - 1 AS level_index
  FROM (SELECT DISTINCT coalesce(CASE WHEN additive_smiles IS NOT NULL THEN concat('=', additive_smiles) END, 'null') AS level_key FROM meas)) v
ON v.level_key = coalesce(CASE WHEN l.additive_smiles IS NOT NULL THEN concat('=', l.additive_smiles) END, 'null')""".replace(
            "coalesce(concat('=', additive_smiles), 'null')", "coalesce(additive_smiles, 'null')"),
        "expand_vector_columns": "SELECT mol_id, " + ", ".join(f"{r6(f'fp[{i + 1}]')} AS fp_all_{i}" for i in range(Q.FP_WIDTH)) + " FROM mol LEFT JOIN descr USING (mol_id)",
        "qgram_fingerprint": _grams("mol", "mol_id", "smiles"),
        "qgram_documents": _grams("documents", "doc_id", "text"),
        "expert_features": f"""SELECT sample_id, CAST(length(regexp_extract(surfactant_smiles, '^(C+)', 1)) AS INT) AS tail_c_number,
  {cls} AS surfactant_class, {r6('w.molecular_weight')} AS molecular_weight FROM meas JOIN mol w USING (mol_id)""",
        "descriptor_set": "SELECT sample_id, " + ", ".join(
            (f"CASE WHEN mol_id % 25 = 0 THEN 0.0 ELSE {r6('fp[4]')} END AS descr_3" if i == 3 else f"{r6(f'fp[{i + 1}]')} AS descr_{i}")
            for i in range(19)) + " FROM described",
        "impute_mean": _impute(),
        "predict_constant": f"SELECT sample_id, CAST({Q.DUMMY_VALUE} AS DOUBLE) AS predicted_pcmc FROM lab_ok",
        "predict_mean": f"SELECT sample_id, {r6('predicted_pcmc')} AS predicted_pcmc FROM lab_scored",
        "huber_loss": f"""SELECT {cls} AS surfactant_class, {r6("avg(CASE WHEN abs(pcmc - predicted_pcmc) <= 0.5 THEN 0.5 * (pcmc - predicted_pcmc) ** 2 ELSE 0.5 * (abs(pcmc - predicted_pcmc) - 0.25) END)")} AS huber
FROM lab_scored GROUP BY 1""",
        "score_batch_udf": f"""SELECT sample_id, {r6(f"{Q.LINEAR_INTERCEPT} + {Q.LINEAR_WEIGHTS[0]} * ({carbons()}) + {Q.LINEAR_WEIGHTS[1]} * temperature + {Q.LINEAR_WEIGHTS[2]} * coalesce(additive_concentration, 0.0)")} AS predicted_pcmc FROM lab_ok""",
        "standardize_features": _standard(),
        "prediction_log": """SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged_at, user_id, round(value / 100, 4) AS predicted_pcmc,
  printf('%.6e', pow(10.0, -(value / 100))) AS predicted_cmc_m, '' AS feedback, CAST(NULL AS DOUBLE) AS actual_pcmc FROM events""",
        "merge_feedback": f"""SELECT CAST(e.event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged_at, user_id, round(value / 100, 4) AS predicted_pcmc,
  printf('%.6e', pow(10.0, -(value / 100))) AS predicted_cmc_m, coalesce(g.feedback, '') AS feedback, {r6('g.actual')} AS actual_pcmc
FROM events e LEFT JOIN (
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Good' WHEN 1 THEN 'Overestimated' WHEN 3 THEN 'Bad' ELSE 'Underestimated' END AS feedback, value / 10 AS actual
  FROM events WHERE event_id % 3 = 0 AND event_id % 5 <> 2 AND (value IS NULL OR value / 10 BETWEEN 0 AND 10)) g ON g.event_id = e.event_id""",
        "log_drift": f"""SELECT input_key, count(*) AS n_predictions, min(predicted_pcmc) AS min_pcmc, max(predicted_pcmc) AS max_pcmc,
  {r6('max(predicted_pcmc) - min(predicted_pcmc)')} AS spread FROM predlog GROUP BY 1 HAVING count(*) > 1""",
    }
    extra = {
        "papers1": f"SELECT smiles AS surfactant_smiles, T AS temperature, CAST(NULL AS VARCHAR) AS additive_smiles, CAST(NULL AS DOUBLE) AS additive_concentration, pCMC AS pcmc FROM paper1",
        "papers4": f"SELECT String AS surfactant_smiles, T_C AS temperature, CAST(NULL AS VARCHAR) AS additive_smiles, CAST(NULL AS DOUBLE) AS additive_concentration, 6.0 - log_cmc_um AS pcmc FROM paper4",
        "meas_known": "SELECT sample_id, pcmc FROM meas WHERE pcmc IS NOT NULL",
        "meas_binned": VIEWS["binned"].replace("FROM known k", "FROM meas_known k").replace("FROM known)", "FROM meas_known)"),
    }
    out = {name: with_views(sql, extra) for name, sql in plain.items()}

    # Neighbour searches, by brute force over whole tables.
    out["impute_knn"] = with_views(
        f"SELECT a.sample_id, f.filled AS conc_imputed FROM ask a JOIN filled f USING (carbons, temp, additive) WHERE a.conc IS NULL",
        knn_views("known", "lab"))
    out["predict_knn"] = with_views(f"SELECT sample_id, {r6('predicted_pcmc')} AS predicted_pcmc FROM scored", knn_views("known", "lab_ok"))
    out["predict_missing_knn"] = with_views(
        f"SELECT {COND}, {r6('predicted_pcmc')} AS predicted_pcmc FROM scored",
        {"unknown": "SELECT * FROM merged WHERE pcmc IS NULL", **knn_views("known", "unknown")})
    out["external_validation_knn"] = with_views(f"SELECT side, {METRIC_COLUMNS} FROM scored GROUP BY 1", knn_views("known", "pool"))
    out["experiment_table"] = _experiment()
    out["features_expert_lingo"] = _expert_lingo()
    out["features_descr_chen"] = _descr_chen()
    out["train_test_modes"] = _train_test_modes()
    # What must hold of any principal components and of any least point: zeros.
    zeros = ", ".join(f"CAST(0.0 AS DOUBLE) AS {c}" for c in ("mean", "other", "variance_gap", "residual"))
    out["pca_checks"] = out["pca_checks_excluded_unscaled"] = f"SELECT concat('PC', CAST(i AS VARCHAR)) AS component, {zeros} FROM range(1, 11) t(i)"
    out["embedding_head_optimum"] = f"SELECT CAST(i AS INT) AS entry, CAST(0.0 AS DOUBLE) AS gradient FROM range({2 * Q.FP_WIDTH + 5}) t(i)"
    out["pca_total_variance"] = _total_variance()
    out["csv_round_trip"] = _csv_round_trip()
    out["predictions_sink"] = with_views(f"""SELECT surfactant_smiles, temperature, additive_smiles, additive_concentration,
  {r6('(SELECT avg(pcmc) FROM everything)')} AS predicted_pcmc FROM everything WHERE pcmc IS NULL""")
    out["prediction_log_inputs"] = with_views(f"""SELECT sample_id AS id, '{Q.LOGGED_AT}' AS logged_at, surfactant_smiles, temperature, additive_smiles,
  additive_concentration, round(predicted_pcmc, 4) AS predicted_pcmc, printf('%.6e', pow(10.0, -predicted_pcmc)) AS predicted_cmc_m,
  '' AS feedback, CAST(NULL AS DOUBLE) AS actual_pcmc FROM lab_scored""")
    out["load_violations"] = _load_violations()
    swept = {"swept": f"SELECT p.*, CAST(v.step AS INT) AS step, v.temperature FROM profiles p, {values('v', Q.PROFILE_TEMPERATURES)}"}
    out["profile_knn"] = with_views(
        f"SELECT {COND}, step, {r6('predicted_pcmc')} AS predicted_pcmc FROM scored", {**swept, **knn_views("known", "swept")})
    sweep = {"swept": f"SELECT p.*, CAST(v.step AS INT) AS step, v.temperature FROM profiles p, {values('v', Q.SWEEP_TEMPERATURES)}"}
    out["sweep_curve"] = with_views(f"""SELECT surfactant_smiles, additive_smiles, additive_concentration, 'curve' AS kind, temperature,
  {r6('predicted_pcmc')} AS value, {r6('predicted_pcmc - 0.1')} AS band_low, {r6('predicted_pcmc + 0.1')} AS band_high FROM scored
UNION ALL SELECT p.surfactant_smiles, p.additive_smiles, p.additive_concentration, 'observed', k.temperature, {r6('k.pcmc')}, NULL, NULL
FROM profiles p JOIN known k ON k.surfactant_smiles = p.surfactant_smiles AND k.additive_smiles IS NOT DISTINCT FROM p.additive_smiles""",
                                    {**sweep, **knn_views("known", "swept")})
    out["sweep_with_observed"] = with_views(f"""SELECT s.*, coalesce(o.n_observed, 0) AS n_observed, {r6('o.m')} AS observed_mean FROM (
  SELECT surfactant_smiles, additive_smiles, additive_concentration, count(predicted_pcmc) AS n_points, {r6('min(predicted_pcmc)')} AS min_pcmc,
    {r6('max(predicted_pcmc)')} AS max_pcmc, {r6('avg(predicted_pcmc)')} AS mean_pcmc FROM scored GROUP BY 1, 2, 3) s
LEFT JOIN (SELECT surfactant_smiles, additive_smiles, count(*) AS n_observed, avg(pcmc) AS m FROM known GROUP BY 1, 2) o
  ON o.surfactant_smiles = s.surfactant_smiles AND o.additive_smiles IS NOT DISTINCT FROM s.additive_smiles""",
        {**sweep, **knn_views("known", "swept")})
    out["cv_knn"] = _cv_knn()
    out["ablation_table"] = _ablation()
    return out
