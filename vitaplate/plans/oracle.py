"""Independent SQL spelling of every catalogue query, for DuckDB over the driver tables.

The surrogate views of FIXTURES.md are written here as CTEs.  Missing-value
rules are spelled out in SQL (CASE for x/0, FILTER for conditional counts,
``IS NOT DISTINCT FROM`` for null-safe keys, explicit NULLS LAST, ranked counts
instead of ``mode``).
"""

from __future__ import annotations

from vitaplate.plans.output import sql_rounded


def ieee(num: str, den: str) -> str:
    """x/0 -> +-Infinity, 0/0 and NaN -> NULL (the Spark side's ``ieee_div``)."""
    return (
        f"(CASE WHEN ({den}) <> 0 THEN (CASE WHEN isnan(({num}) / ({den})) THEN NULL ELSE ({num}) / ({den}) END) "
        f"WHEN ({den}) = 0 AND ({num}) > 0 THEN CAST('Infinity' AS DOUBLE) "
        f"WHEN ({den}) = 0 AND ({num}) < 0 THEN CAST('-Infinity' AS DOUBLE) END)"
    )


def num_label(x: str) -> str:
    """Shortest decimal text of a double (20 -> '20', 0.74 -> '0.74')."""
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


OBJECTS = """objects AS (
  SELECT concat('E', CAST(o_custkey % 4 AS VARCHAR)) AS exp_id,
         c_mktsegment AS patient,
         CASE l_returnflag WHEN 'N' THEN 'Media' WHEN 'A' THEN 'IRI' ELSE 'STA' END AS compound,
         CASE l_returnflag WHEN 'N' THEN CAST(NULL AS DOUBLE)
              WHEN 'A' THEN CAST(20 * (CAST(round(l_discount * 100) AS INTEGER) % 4) AS DOUBLE)
              ELSE CAST(5 AS DOUBLE) END AS concentration,
         CAST(list_extract([0, 1, 2, 3, 5, 7, 10], year(l_shipdate) - 1994) AS INTEGER) AS day,
         CASE WHEN l_returnflag = 'R' AND year(l_shipdate) = 1995 AND c_mktsegment = 'FURNITURE' THEN 'Dead'
              WHEN l_returnflag = 'A' AND l_suppkey % 2 = 0 AND c_mktsegment = 'HOUSEHOLD' THEN 'Live'
              WHEN l_linestatus = 'O' THEN 'Live' ELSE 'Dead' END AS ld,
         l_suppkey % 2 AS plate_row, l_linenumber % 2 + 1 AS plate_col,
         l_quantity AS region_area, l_extendedprice AS region_intensity,
         CASE WHEN l_partkey % 97 = 0 THEN CAST(NULL AS DOUBLE) ELSE l_tax END AS region_texture,
         l_partkey AS object_no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)"""

WELL_COUNTS = """well_counts AS (
  SELECT day, compound, concentration, patient,
         concat(CAST(plate_row AS VARCHAR), '_', exp_id) AS well_row, plate_col AS well_col,
         count(*) FILTER (WHERE ld = 'Live') AS live,
         count(*) FILTER (WHERE ld = 'Dead') AS dead
  FROM objects GROUP BY ALL
)"""


def _normalised(metric: str, source: str = "well_counts", keys: str = "patient, compound, concentration") -> str:
    ratio = ieee("live", "live + dead") if metric == "proportion" else ieee("live", "dead")
    return f"""per_well AS (SELECT *, {ratio} AS plive FROM {source}),
stats AS (
  SELECT {keys}, day,
         count(plive) AS n_wells,
         CASE WHEN count(*) FILTER (WHERE isinf(plive)) > 0 THEN max(plive) ELSE avg(plive) END AS live_mean,
         CASE WHEN count(*) FILTER (WHERE isinf(plive)) > 0 THEN NULL ELSE stddev_samp(plive) END AS live_sd
  FROM per_well GROUP BY ALL
),
based AS (
  SELECT *, first_value(live_mean) OVER (PARTITION BY {keys} ORDER BY day NULLS LAST
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base
  FROM stats
),
norm AS (SELECT {keys}, day, n_wells, live_mean, live_sd,
                {ieee('live_mean', 'base')} AS nlive, {ieee('live_sd', 'base')} AS nlive_sd FROM based)"""


NORM_COLS = ["live_mean", "live_sd", "nlive", "nlive_sd"]


def _q(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def mean_strict(x: str) -> str:
    return f"(CASE WHEN count({x}) = count(*) THEN avg({x}) END)"


def treatments(src: str, p: str) -> str:
    """Treatment order table of ``src`` as CTEs named {p}_d, {p}_n, {p}_j, {p}_pin, {p}_o."""
    label = f"concat(compound, CASE WHEN concentration IS NULL THEN '' ELSE concat('_', {num_label('concentration')}) END)"
    return f"""{p}_d AS (SELECT DISTINCT compound, concentration FROM {src}),
{p}_n AS (SELECT compound, count(*) AS n_doses FROM {p}_d GROUP BY compound),
{p}_j AS (SELECT {p}_d.compound, {p}_d.concentration, {p}_n.n_doses FROM {p}_d
          JOIN {p}_n ON {p}_d.compound IS NOT DISTINCT FROM {p}_n.compound),
{p}_pin AS (SELECT count(*) AS n FROM {p}_j WHERE n_doses = 1 AND lower(compound) IN ('media', 'control')),
{p}_o AS (
  SELECT compound, concentration, {label} AS treatment,
         CAST(row_number() OVER (ORDER BY CASE WHEN n_doses = 1 THEN 0 ELSE 1 END,
              CASE WHEN n_doses = 1 AND lower(compound) IN ('media', 'control') AND (SELECT n FROM {p}_pin) = 1
                   THEN 0 ELSE 1 END,
              compound NULLS LAST, concentration NULLS LAST) AS INTEGER) AS treatment_rank,
         CAST(dense_rank() OVER (ORDER BY CASE WHEN n_doses = 1 THEN 0 ELSE 1 END,
              CASE WHEN n_doses = 1 AND lower(compound) IN ('media', 'control') AND (SELECT n FROM {p}_pin) = 1
                   THEN 0 ELSE 1 END, compound NULLS LAST) AS INTEGER) AS compound_rank,
         CAST(n_doses AS INTEGER) AS n_doses,
         CAST((SELECT count(*) FROM {p}_n) AS INTEGER) AS n_compounds,
         CAST((SELECT count(*) FROM {p}_n WHERE lower(compound) IN ('media', 'control')) AS INTEGER) AS n_controls
  FROM {p}_j)"""


def _tjoin(a: str, t: str, alias: str = "t") -> str:
    return (f"LEFT JOIN {t} {alias} ON {a}.compound IS NOT DISTINCT FROM {alias}.compound "
            f"AND {a}.concentration IS NOT DISTINCT FROM {alias}.concentration")


def _dose_response(metric: str) -> str:
    sql = _q(OBJECTS, WELL_COUNTS, _normalised(metric), body="SELECT * FROM norm")
    return sql_rounded(sql, NORM_COLS)


WELL_KEY = "concat(CAST(plate_row AS VARCHAR), '_', exp_id)"

WELL_FEATURE = f"""SELECT day, compound, concentration, patient, {WELL_KEY} AS well_row, plate_col AS well_col,
       avg(region_area) FILTER (WHERE ld = 'Live') AS live,
       avg(region_area) FILTER (WHERE ld = 'Dead') AS dead
FROM objects GROUP BY ALL"""

GROWTH = f"""wells AS (
  SELECT day, compound, concentration, patient, {WELL_KEY} AS well_row, plate_col AS well_col,
         avg(region_area) FILTER (WHERE ld = 'Live') AS live
  FROM objects WHERE compound = 'Media' GROUP BY ALL)"""

CURVES = f"""ct AS (
  SELECT n.patient, n.compound, n.concentration, n.day, t.treatment, t.treatment_rank,
         n.nlive AS val, n.nlive_sd AS dev, n.nlive - n.nlive_sd AS lower, n.nlive + n.nlive_sd AS upper
  FROM norm n {_tjoin('n', 'tr_o')}
  WHERE n.nlive IS NOT NULL AND abs(n.nlive) <> CAST('Infinity' AS DOUBLE))"""

EXTENTS = """SELECT patient,
       coalesce(CASE WHEN (CASE WHEN lo > 0 THEN 0.0 ELSE lo END) < 0 THEN 0.0
                     ELSE floor(CASE WHEN lo > 0 THEN 0.0 ELSE lo END) END, 0.0) AS y_min,
       CASE WHEN hi < 2 THEN round_even(hi, 1) ELSE CAST(ceil(hi) AS DOUBLE) END AS y_max,
       CAST(n_days AS INTEGER) AS n_days
FROM (SELECT patient, max(upper) AS hi, min(lower) AS lo, count(DISTINCT day) AS n_days FROM ct GROUP BY patient) g"""

DOSE_FILTER = """SELECT exp_id, patient, compound, concentration, day, ld, region_area FROM objects
WHERE ((compound = 'IRI' AND concentration = 20) OR (compound = 'IRI' AND concentration = 40)
       OR (compound = 'OXA' AND concentration = 20) OR compound IN ('STA', 'Media')) AND day <> 0"""

# Surrogate feature columns and their cleaned labels (object_no is id-like and dropped).
FEATURES = (("region_area", "Area [µm²]"), ("region_intensity", "Intensity Mean"), ("region_texture", "Texture SER Spot"))
IDS = "exp_id, patient, compound, concentration, day, ld, plate_row, plate_col"


def _feature_long(where: str, ids: str = IDS, value: str = "value") -> str:
    parts = [f"SELECT {ids}, '{lab}' AS variable, CAST({col} AS DOUBLE) AS {value} FROM objects WHERE {where}"
             for col, lab in FEATURES]
    return "\nUNION ALL\n".join(parts)


def _sample(parts: list[tuple[str, str]]) -> str:
    texts = []
    for col, kind in parts:
        t = num_label(col) if kind == "double" else f"CAST({col} AS VARCHAR)"
        texts.append(f"coalesce({t}, 'NA')")
    return "concat_ws('_', " + ", ".join(texts) + ")"


def _heatmap(where: str, keys: list[str], sample: list[tuple[str, str]], scale: str) -> str:
    k = ", ".join(keys)
    means = ", ".join(f"{mean_strict(c)} AS f{i}" for i, (c, _) in enumerate(FEATURES))
    longs = "\nUNION ALL\n".join(f"SELECT {k}, '{lab}' AS variable, f{i} AS mean_val FROM m" for i, (_, lab) in enumerate(FEATURES))
    if scale == "z":
        scaled = ("(mean_val - avg(mean_val) OVER w) / nullif(stddev_samp(mean_val) OVER w, 0)")
    else:
        scaled = ("mean_val / nullif(sqrt(sum(mean_val * mean_val) OVER w / greatest(1, count(mean_val) OVER w - 1)), 0)")
    return f"""m AS (SELECT {k}, {means} FROM objects WHERE {where} GROUP BY ALL),
l AS ({longs}),
hm AS (SELECT {_sample(sample)} AS sample, {k}, variable, mean_val, {scaled} AS scaled FROM l WINDOW w AS (PARTITION BY variable))"""


HM_Z_KEYS = ["exp_id", "ld", "compound", "patient", "day"]
HM_Z_WHERE = "compound IN ('Media', 'STA')"
HM_Z_SAMPLE = [("patient", "s"), ("day", "s"), ("exp_id", "s"), ("compound", "s"), ("ld", "s")]


def _distance() -> str:
    labels = sorted(lab for _, lab in FEATURES)
    cols = {lab: f"c{i}" for i, lab in enumerate(labels)}
    piv = ", ".join(f"max(scaled) FILTER (WHERE variable = '{lab}') AS {cols[lab]}" for lab in labels)
    parts = []
    for i in range(len(labels)):
        for j in range(i + 1, len(labels)):
            a, b = cols[labels[i]], cols[labels[j]]
            d = f"({a} - {b})"
            parts.append(
                f"SELECT '{labels[i]}' AS feature_a, '{labels[j]}' AS feature_b, "
                f"CASE WHEN count({d}) > 0 THEN sqrt(sum({d} * {d}) * count(*) / count({d})) END AS distance, "
                f"count({d}) AS n_samples FROM wide"
            )
    return _q(OBJECTS, _heatmap(HM_Z_WHERE, HM_Z_KEYS, HM_Z_SAMPLE, "z"),
              f"wide AS (SELECT sample, {piv} FROM hm GROUP BY sample)", body="\nUNION ALL\n".join(parts))


def _density() -> str:
    vals = _feature_long("day = 3 AND compound IN ('Media', 'Control', 'STA')", ids="compound, patient", value="x")
    return _q(
        OBJECTS,
        f"vv AS (SELECT * FROM ({vals}) WHERE x IS NOT NULL)",
        """st AS (SELECT variable, compound, patient, count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx,
                 max(abs(x)) AS amax, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3
          FROM vv GROUP BY ALL HAVING count(*) >= 2)""",
        """bw AS (SELECT *, 0.9 * (CASE WHEN least(sd, (q3 - q1) / 1.34) > 0 THEN least(sd, (q3 - q1) / 1.34)
                                   WHEN sd > 0 THEN sd WHEN amax > 0 THEN amax ELSE 1.0 END)
                       * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM st)""",
        "gr AS (SELECT *, mn - 3.0 * bw AS g0, (mx - mn + 6.0 * bw) / 511 AS step FROM bw)",
        """b AS (SELECT vv.variable, vv.compound, vv.patient, (x - g0) / step AS pos
         FROM vv JOIN gr ON vv.variable = gr.variable AND vv.compound = gr.compound AND vv.patient = gr.patient)""",
        """bins AS (SELECT variable, compound, patient, bin, sum(w) AS w FROM (
            SELECT variable, compound, patient, CAST(floor(pos) AS INTEGER) AS bin, 1 - (pos - floor(pos)) AS w FROM b
            UNION ALL
            SELECT variable, compound, patient, CAST(floor(pos) AS INTEGER) + 1 AS bin, pos - floor(pos) AS w FROM b)
          GROUP BY ALL)""",
        """conv AS (SELECT bins.variable, bins.compound, bins.patient, CAST(g.range AS INTEGER) AS g,
                sum(w * exp(-0.5 * ((g.range - bin) * step / bw) * ((g.range - bin) * step / bw)) / sqrt(2 * pi())) AS k,
                any_value(n) AS n, any_value(bw) AS bw, any_value(g0) AS g0, any_value(step) AS step
          FROM bins JOIN gr ON bins.variable = gr.variable AND bins.compound = gr.compound AND bins.patient = gr.patient
          CROSS JOIN range(0, 512) g
          GROUP BY ALL)""",
        "dens AS (SELECT variable, compound, patient, g, g0 + g * step AS x, k / (n * bw) AS density FROM conv)",
        body="SELECT *, density / max(density) OVER (PARTITION BY variable, compound, patient) AS scaled FROM dens",
    )


VISITS = """visits AS (
  SELECT id, compound,
         CAST(CASE pos WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 7 ELSE pos + 2 END AS BIGINT) AS day,
         ml_live, vd_live, intensity
  FROM (SELECT concat(CAST(user_id AS VARCHAR), '_', CAST(CAST(ts AS DATE) AS VARCHAR)) AS id,
               CASE WHEN user_id % 2 = 0 THEN 'Media' ELSE 'STA' END AS compound, event_id,
               CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END AS ml_live,
               CASE WHEN value >= 10 THEN 1 ELSE 0 END AS vd_live, value AS intensity,
               row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS pos
        FROM events) e
  WHERE event_id % 11 <> 0)"""

STATUS = """CASE WHEN {m} = 1 AND {v} = 1 THEN 'L-ML_L-VD' WHEN {m} = 1 AND {v} = 0 THEN 'L-ML_D-VD'
            WHEN {m} = 0 AND {v} = 1 THEN 'D-ML_L-VD' WHEN {m} = 0 AND {v} = 0 THEN 'D-ML_D-VD' ELSE '0' END"""

COHORT = f"""qual AS (SELECT compound, id FROM visits GROUP BY compound, id HAVING count(*) >= 5),
kept AS (SELECT v.*, {STATUS.format(m='ml_live', v='vd_live')} AS status FROM visits v
         WHERE EXISTS (SELECT 1 FROM qual q WHERE q.compound = v.compound AND q.id = v.id)),
codes AS (SELECT status, CAST(row_number() OVER (ORDER BY status) AS INTEGER) AS status_num
          FROM (SELECT DISTINCT status FROM kept)),
cohort AS (SELECT DISTINCT kept.id, kept.day, kept.status, codes.status_num, kept.intensity, kept.compound
           FROM kept JOIN codes ON kept.status = codes.status WHERE kept.day <> 2)"""

STATE_CODES = "(VALUES ('D-ML_D-VD', 1), ('D-ML_L-VD', 2), ('L-ML_D-VD', 3), ('L-ML_L-VD', 4))"

LINKS = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY compound, id ORDER BY day NULLS LAST, status NULLS LAST,
                                               intensity NULLS LAST) AS pos FROM cohort),
pairs AS (SELECT a.compound, a.pos, a.day AS d0, a.status AS s0, b.day AS d1, b.status AS s1
          FROM ranked a JOIN ranked b ON a.compound = b.compound AND a.id = b.id AND b.pos = a.pos + 1
          WHERE a.pos <= 3),
hits AS (SELECT p.*, st.stage FROM pairs p
         JOIN (VALUES (1, 1, 0, 1), (2, 2, 1, 3), (3, 3, 3, 7)) st(stage, spos, sd0, sd1)
           ON p.pos = st.spos AND p.d0 = st.sd0 AND p.d1 = st.sd1),
cnt AS (SELECT compound, stage, s0, s1, d0, d1, count(*) AS count FROM hits GROUP BY ALL),
coded AS (SELECT cnt.*, sc.code AS src_code, tc.code AS tgt_code FROM cnt
          JOIN {STATE_CODES} sc(state, code) ON cnt.s0 = sc.state
          JOIN {STATE_CODES} tc(state, code) ON cnt.s1 = tc.state),
links AS (SELECT compound, CAST(stage AS INTEGER) AS stage,
                 CAST(row_number() OVER (PARTITION BY compound ORDER BY stage, src_code DESC, tgt_code) AS INTEGER) AS link_order,
                 concat(CAST(d0 AS VARCHAR), '_', s0) AS source, concat(CAST(d1 AS VARCHAR), '_', s1) AS target, count,
                 CASE WHEN regexp_extract(concat(CAST(d0 AS VARCHAR), '_', s0), '_(.)-ML_(.)', 1)
                         = regexp_extract(concat(CAST(d0 AS VARCHAR), '_', s0), '_(.)-ML_(.)', 2)
                      THEN 'type_b' ELSE 'type_a' END AS "group"
          FROM coded)"""

NODES = """ends AS (SELECT compound, source AS name, (0, link_order) AS k FROM links
         UNION ALL SELECT compound, target AS name, (1, link_order) AS k FROM links),
firsts AS (SELECT compound, name, min(k) AS k FROM ends GROUP BY ALL),
nodes AS (SELECT compound, name, CAST(row_number() OVER (PARTITION BY compound ORDER BY k) - 1 AS INTEGER) AS node_id,
                 CASE WHEN regexp_extract(name, '_(.)-ML_(.)', 1) = regexp_extract(name, '_(.)-ML_(.)', 2)
                      THEN 'a' ELSE 'b' END AS node_group FROM firsts)"""

EVENT_VISITS = VISITS.replace("ml_live, vd_live, intensity\n", "state, intensity\n").replace(
    "CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END AS ml_live,",
    "CASE WHEN value >= 1 THEN event_type END AS state,").replace("CASE WHEN value >= 10 THEN 1 ELSE 0 END AS vd_live, ", "")

EVENT_LINKS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY compound, id ORDER BY day NULLS LAST, state NULLS LAST,
                                               intensity NULLS LAST) AS pos FROM visits),
cnt AS (SELECT a.compound, st.stage, coalesce(a.state, 'NA') AS s0, coalesce(b.state, 'NA') AS s1, a.day AS d0, b.day AS d1, count(*) AS count
        FROM ranked a JOIN ranked b ON a.compound = b.compound AND a.id = b.id AND b.pos = a.pos + 1
        JOIN (VALUES (1, 1, 0, 1), (2, 2, 1, 3), (3, 3, 3, 7)) st(stage, spos, sd0, sd1)
          ON a.pos = st.spos AND a.day = st.sd0 AND b.day = st.sd1
        GROUP BY ALL)"""

SURVEY = """sv AS (SELECT CAST(doc_id AS VARCHAR) AS respondent, source AS grp, lang,
                  CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic
           FROM labels JOIN documents USING (doc_id)),
lg AS (SELECT respondent, grp, 'lang' AS variable, lang AS value FROM sv
       UNION ALL SELECT respondent, grp, 'quality', quality FROM sv
       UNION ALL SELECT respondent, grp, 'toxic', toxic FROM sv),
cnt AS (SELECT variable, value, count(*) AS n FROM lg WHERE value IS NOT NULL GROUP BY ALL),
mj AS (SELECT variable, value FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) AS r
                                    FROM cnt) WHERE r = 1),
al AS (SELECT grp, variable, value FROM lg UNION ALL SELECT 'Majority' AS grp, variable, value FROM mj)"""


def _side(imaging: bool) -> str:
    call = ("CASE WHEN l_quantity >= 20 THEN 'Live' ELSE 'Dead' END" if imaging
            else "CASE l_linestatus WHEN 'O' THEN 'Live' ELSE 'Dead' END")
    where = "WHERE l_suppkey % 10 <> 0" if imaging else ""
    return f"""SELECT concat(CAST(l_orderkey AS VARCHAR), '.', CAST(l_linenumber AS VARCHAR)) AS uid, {call} AS ld,
       l_quantity AS quantity,
       CASE l_returnflag WHEN 'N' THEN 'Media' WHEN 'A' THEN 'IRI' ELSE 'STA' END AS compound,
       CASE l_returnflag WHEN 'N' THEN CAST(NULL AS DOUBLE)
            WHEN 'A' THEN CAST(20 * (CAST(round(l_discount * 100) AS INTEGER) % 4) AS DOUBLE)
            ELSE CAST(5 AS DOUBLE) END AS concentration,
       CAST(list_extract([0, 1, 2, 3, 5, 7, 10], year(l_shipdate) - 1994) AS INTEGER) AS day, c_mktsegment AS patient,
       l_suppkey % 2 AS plate_row, l_linenumber % 2 + 1 AS plate_col
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey {where}"""


UNIFIED = f"""vd AS ({_side(False)}),
ml AS ({_side(True)}),
vdu AS (SELECT * FROM vd WHERE uid IN (SELECT uid FROM vd GROUP BY uid HAVING count(*) = 1)),
uni AS (SELECT v.uid, m.compound, m.concentration, m.day, m.patient, m.plate_row, m.plate_col, m.quantity,
               m.ld AS ld_Imaging, v.ld AS ld_VD
        FROM vdu v LEFT JOIN ml m ON v.uid = m.uid)"""

RESTACKED = """rs AS (
  SELECT uid, concat(coalesce(compound, 'NA'), '_VD') AS compound, concentration, day, patient, plate_row, plate_col,
         quantity, ld_VD AS ld, concat(coalesce(compound, 'NA'), '_VD') AS treatment, '_VD' AS assay FROM uni
  UNION ALL
  SELECT uid, concat(coalesce(compound, 'NA'), '_Imaging') AS compound, concentration, day, patient, plate_row, plate_col,
         quantity, ld_Imaging AS ld, concat(coalesce(compound, 'NA'), '_Imaging') AS treatment, '_Imaging' AS assay FROM uni)"""

PLATES = """plates AS (
  SELECT concat(o_orderstatus, CAST(list_extract([1, 3, 7], o_custkey % 3 + 1) AS VARCHAR)) AS plate,
         list_extract([1, 3, 7], o_custkey % 3 + 1) AS day,
         CASE o_orderpriority WHEN '1-URGENT' THEN list_extract(['Media', 'control', 'media', NULL], o_custkey % 4 + 1) WHEN '2-HIGH' THEN 'IRI' WHEN '3-MEDIUM' THEN 'STA'
                              WHEN '5-LOW' THEN 'ATP' ELSE 'NOC' END AS compound,
         CASE o_orderpriority WHEN '1-URGENT' THEN CAST(NULL AS DOUBLE)
                              WHEN '2-HIGH' THEN CAST(20 * (o_custkey % 4) AS DOUBLE)
                              WHEN '3-MEDIUM' THEN CAST(5 AS DOUBLE)
                              WHEN '5-LOW' THEN CAST(o_custkey % 2 AS DOUBLE)
                              ELSE CASE WHEN o_custkey % 5 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END END AS concentration,
         'BUILDING' AS patient,
         o_totalprice * CASE o_orderpriority WHEN '5-LOW' THEN CAST(0.01 AS DOUBLE) WHEN '2-HIGH' THEN CAST(0.5 AS DOUBLE)
                                             WHEN '3-MEDIUM' THEN CAST(0.25 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS signal
  FROM orders),
bgv AS (SELECT plate, avg(signal) FILTER (WHERE compound = 'ATP' AND concentration = 0) AS bg FROM plates GROUP BY plate),
bgp AS (
  SELECT p.plate, p.day,
         CASE WHEN p.compound IS NULL OR p.compound IN ('control', 'Control', 'media') THEN 'Media' ELSE p.compound END AS compound,
         p.concentration, p.patient, p.signal - bgv.bg AS signal
  FROM plates p LEFT JOIN bgv ON p.plate IS NOT DISTINCT FROM bgv.plate
  WHERE coalesce(p.plate <> 'F3' OR p.concentration IS NULL OR NOT p.concentration IN (0.25), true))"""

PLATE_NORM = f"""per AS (SELECT compound, concentration, day, {mean_strict('signal')} AS mean,
                CASE WHEN count(signal) = count(*) THEN stddev_samp(signal) END AS sd
         FROM bgp WHERE compound <> 'ATP' GROUP BY ALL),
ctrl AS (SELECT day, {mean_strict('mean')} AS c FROM per WHERE compound = 'Media' GROUP BY day),
pn AS (SELECT per.*, {ieee('mean', 'c')} AS norm_mean, {ieee('sd', 'c')} AS norm_sd FROM per LEFT JOIN ctrl USING (day))"""

CONCORDANCE = f"""img AS (SELECT n.patient, n.compound, n.concentration, n.day, n.live_mean,
                CASE WHEN t.treatment = 'STA' THEN 'STA_5' ELSE t.treatment END AS treatment
         FROM norm n {_tjoin('n', 'it_o')}),
pl AS (SELECT plate, day, compound, concentration, signal, pp.patient FROM bgp
       CROSS JOIN (VALUES ('BUILDING'), ('MACHINERY')) pp(patient)),
{treatments('pl', 'pt')},
ptr AS (SELECT pl.day, pl.concentration, pl.signal, pl.patient,
               CASE WHEN t.treatment = 'media' THEN 'Media' WHEN t.treatment = 'STA' THEN 'STA_5' ELSE t.treatment END AS treatment
        FROM pl {_tjoin('pl', 'pt_o')}),
j AS (SELECT ptr.day, ptr.treatment, ptr.patient, ptr.signal, img.live_mean FROM ptr JOIN img
        ON ptr.day IS NOT DISTINCT FROM img.day AND ptr.treatment IS NOT DISTINCT FROM img.treatment
       AND ptr.patient IS NOT DISTINCT FROM img.patient AND ptr.concentration IS NOT DISTINCT FROM img.concentration),
s AS (SELECT day, treatment, patient, {mean_strict('signal')} AS mean_sig, {mean_strict('live_mean')} AS mean_pa
      FROM j GROUP BY ALL),
normed AS (SELECT *, {ieee('mean_sig', "max(CASE WHEN treatment = 'Media' THEN mean_sig END) OVER (PARTITION BY day)")} AS norm_media
           FROM s),
conc AS (SELECT * FROM normed
         WHERE coalesce(NOT treatment IN ('IRI_40', 'OXA_20', 'OXA_40', 'Media', 'IRI_0.74', 'IRI_2.22', 'IRI_6.66',
                                          'IRI_0.082', 'IRI_0.25'), true)
           AND day IN (1, 3, 7))"""


def _concordance_ctes() -> list[str]:
    return [OBJECTS, WELL_COUNTS, _normalised("proportion"), treatments("norm", "it"), PLATES, CONCORDANCE]


def oracle_sql() -> dict[str, str]:
    hm_media = _heatmap("compound = 'Media'", ["exp_id", "compound", "patient", "day"],
                        [("patient", "s"), ("day", "s"), ("exp_id", "s")], "z")
    rms_where = ("((compound = 'OXA' AND concentration = 20) OR (compound = 'IRI' AND concentration IN (20)) "
                 "OR compound IN ('Media', 'STA', 'STA 5')) AND day <> 0 AND ld = 'Dead'")
    hm_rms = _heatmap(rms_where, ["compound", "concentration", "patient", "day", "ld"],
                      [("patient", "s"), ("day", "s"), ("compound", "s"), ("concentration", "double")], "rms")
    return {
        "well_counts": _q(OBJECTS, WELL_COUNTS, body="SELECT * FROM well_counts"),
        "well_feature_mean": sql_rounded(_q(OBJECTS, body=WELL_FEATURE), ["live", "dead"]),
        "growth_curve": sql_rounded(_q(OBJECTS, GROWTH, body="""SELECT patient, compound, concentration, day,
            count(live) AS n_wells, avg(live) AS live_mean, stddev_samp(live) AS live_sd FROM wells GROUP BY ALL"""),
                                    ["live_mean", "live_sd"]),
        "dose_response_proportion": _dose_response("proportion"),
        "dose_response_ratio": _dose_response("ratio"),
        "treatment_order": _q(OBJECTS, treatments("objects", "tr"), body="SELECT * FROM tr_o"),
        "curve_table": sql_rounded(_q(OBJECTS, WELL_COUNTS, _normalised("proportion"), treatments("norm", "tr"), CURVES,
                                      body="SELECT * FROM ct"), ["val", "dev", "lower", "upper"]),
        "curve_extents": sql_rounded(_q(OBJECTS, WELL_COUNTS, _normalised("proportion"), treatments("norm", "tr"), CURVES,
                                        body=EXTENTS), ["y_min", "y_max"]),
        "curve_days": _q(OBJECTS, WELL_COUNTS, _normalised("proportion"), treatments("norm", "tr"), CURVES, body="""
            SELECT patient, day, CAST(row_number() OVER (PARTITION BY patient ORDER BY day) AS INTEGER) AS day_rank
            FROM (SELECT DISTINCT patient, day FROM ct) d"""),
        "plate_extents": sql_rounded(_q(PLATES, PLATE_NORM, body="""
            SELECT compound, floor(CASE WHEN lo > 0 THEN 0.0 ELSE lo END)::DOUBLE AS y_min,
                   CASE WHEN hi < 2 THEN round_even(hi, 1) ELSE CAST(ceil(hi) AS DOUBLE) END AS y_max,
                   CAST(n_days AS INTEGER) AS n_days
            FROM (SELECT compound, max(norm_mean + norm_sd) AS hi, min(norm_mean - norm_sd) AS lo,
                         count(DISTINCT day) AS n_days FROM pn GROUP BY compound) g"""), ["y_min", "y_max"]),
        "patient_origins": sql_rounded(_q(OBJECTS, WELL_COUNTS, _normalised("proportion"), body="""
            SELECT CASE patient WHEN 'BUILDING' THEN 'BUILDING (Primary)' WHEN 'MACHINERY' THEN 'MACHINERY (Metastasis)'
                        ELSE patient END AS patient, compound, concentration, day, nlive FROM norm"""), ["concentration", "nlive"]),
        "feature_heatmap_plain": sql_rounded(_q(OBJECTS, _heatmap("true", ["compound", "concentration", "patient", "day", "ld"],
            [("patient", "s"), ("day", "s"), ("compound", "s"), ("concentration", "double"), ("ld", "s")], "z"), body=(
            "SELECT sample, compound, concentration, patient, day, ld, variable, mean_val FROM hm")), ["concentration", "mean_val"]),
        "consensus_votes": _q(SURVEY, body="""
            SELECT i.label AS variable, i.rank AS item_rank, al.value, g.label AS grp, g.rank AS grp_rank, CAST(count(*) AS BIGINT) AS n
            FROM al LEFT JOIN (VALUES ('quality', '1', 1), ('toxic', '2', 2), ('lang', '3', 3)) i(name, label, rank)
                      ON al.variable = i.name
                    LEFT JOIN (VALUES ('src0', 'Experts', 1), ('Majority', 'Majority', 2), ('src1', 'ML', 3), ('src2', 'Dye', 4))
                      g(name, label, rank) ON al.grp = g.name
            GROUP BY ALL"""),
        "vote_table": _q(SURVEY, body="""
            SELECT value, grp, nullif(count(*) FILTER (WHERE variable = 'quality'), 0) AS quality,
                   nullif(count(*) FILTER (WHERE variable = 'toxic'), 0) AS toxic
            FROM al WHERE value IN ('0', '1') GROUP BY value, grp"""),
        "dose_filter": sql_rounded(_q(OBJECTS, body=DOSE_FILTER), ["concentration", "region_area"]),
        "feature_long": sql_rounded(_q(OBJECTS, body=_feature_long("compound = 'Media'")), ["concentration", "value"]),
        "feature_heatmap_media": sql_rounded(_q(OBJECTS, hm_media, body=(
            "SELECT sample, patient, day, exp_id, variable, mean_val, scaled FROM hm")), ["mean_val", "scaled"]),
        "feature_heatmap_z": sql_rounded(_q(OBJECTS, _heatmap(HM_Z_WHERE, HM_Z_KEYS, HM_Z_SAMPLE, "z"), body=(
            "SELECT * FROM hm")), ["mean_val", "scaled"]),
        "feature_heatmap_rms": sql_rounded(_q(OBJECTS, hm_rms, body="SELECT * FROM hm"),
                                           ["concentration", "mean_val", "scaled"]),
        "feature_distance": sql_rounded(_distance(), ["distance"]),
        "embedding_distance": sql_rounded("""
            WITH l AS (SELECT vec_id, unnest(generate_series(1, len(embedding)))::INTEGER AS i,
                              unnest(embedding)::DOUBLE AS x FROM embeddings),
                 pr AS (SELECT a.i AS i, b.i AS j, a.x - b.x AS d FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.i < b.i)
            SELECT printf('d%02d', i) AS feature_a, printf('d%02d', j) AS feature_b,
                   CASE WHEN count(d) > 0 THEN sqrt(sum(d * d) * (SELECT count(*) FROM embeddings) / count(d)) END
                       AS distance,
                   count(d) AS n_samples
            FROM pr GROUP BY i, j""", ["distance"]),
        "embedding_neighbours": sql_rounded("""
            SELECT sample, CAST(rank AS INTEGER) AS rank, neighbour, distance FROM (
              SELECT a.vec_id AS sample, b.vec_id AS neighbour, list_distance(a.x, b.x) AS distance,
                     row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rank
              FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) a
              JOIN (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) b ON a.vec_id <> b.vec_id)
            WHERE rank <= 5""", ["distance"]),
        "event_links": _q(EVENT_VISITS, EVENT_LINKS, body="""SELECT compound, CAST(stage AS INTEGER) AS stage,
               CAST(row_number() OVER (PARTITION BY compound ORDER BY stage, s0 DESC, s1) AS INTEGER) AS link_order,
               concat(CAST(d0 AS VARCHAR), '_', s0) AS source, concat(CAST(d1 AS VARCHAR), '_', s1) AS target, count,
               'type_b' AS "group" FROM cnt"""),
        "tracked_file_links": _q(VISITS, COHORT, LINKS, body="SELECT * FROM links"),
        "unique_report": _q(f"vd AS ({_side(False)})", "g AS (SELECT split_part(uid, '.', 1) AS o, count(*) AS n FROM vd GROUP BY ALL)",
            "rep AS (SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) FILTER (WHERE n = 1) AS kept_rows FROM g)",
            body="""SELECT patient, day, count(*) AS n, total_rows, kept_rows, total_rows - kept_rows AS removed_rows
                    FROM vd, rep WHERE split_part(uid, '.', 1) IN (SELECT o FROM g WHERE n = 1) GROUP BY ALL"""),
        "unify_decided": sql_rounded(_q(UNIFIED, body="SELECT * FROM uni"), ["concentration", "quantity"]),
        "export_objects": sql_rounded(_q(OBJECTS, body="""
            SELECT patient, compound, concentration, CAST(plate_row AS VARCHAR) AS plate_row, CAST(plate_col AS INTEGER) AS plate_col,
                   region_area AS "Region Area [µm²]", CASE WHEN exp_id <> 'E3' THEN region_texture END AS "Region Texture",
                   object_no AS "Object No", CASE WHEN object_no % 5 <> 0 THEN object_no % 2 = 0 END AS "Focused",
                   CAST(DATE '2020-01-01' + day AS DATE) AS "Imaged", exp_id, day, ld FROM objects"""),
            ["concentration", "Region Area [µm²]", "Region Texture"]),
        "plate_layouts": sql_rounded("""
            WITH l AS (SELECT vec_id % 4 AS plate, unnest(generate_series(0, len(embedding) - 1))::INTEGER AS pos,
                              unnest(embedding)::DOUBLE AS x FROM embeddings)
            SELECT CAST(plate AS INTEGER) AS plate, concat(chr(65 + pos // 8), '0', CAST(pos % 8 + 1 AS VARCHAR)) AS well,
                   CASE pos // 8 WHEN 0 THEN 'Media' WHEN 1 THEN 'ATP' ELSE 'STA' END AS compound,
                   CASE WHEN pos % 8 < 7 THEN (pos % 8) * 0.5::DOUBLE END AS concentration,
                   round(avg(x), 6) AS signal, CAST(count(*) AS DOUBLE) AS vectors
            FROM l GROUP BY plate, pos""", ["concentration", "signal", "vectors"]),
        "partitioned_replace": sql_rounded(_q(PLATES, body="""
            SELECT plate, day, count(*) AS n, avg(CASE WHEN plate = 'F3' THEN signal * 2 ELSE signal END) AS mean_signal
            FROM plates WHERE plate IN ('F3', 'O1') GROUP BY plate, day"""), ["mean_signal"]),
        "feature_density": sql_rounded(_density(), ["x", "density", "scaled"]),
        "tracked_cohort": sql_rounded(_q(VISITS, COHORT, body="SELECT * FROM cohort"), ["intensity"]),
        "transition_links": _q(VISITS, COHORT, LINKS, body="SELECT * FROM links"),
        "transition_nodes": _q(VISITS, COHORT, LINKS, NODES, body="SELECT * FROM nodes"),
        "transition_graph": _q(VISITS, COHORT, LINKS, NODES, body="""SELECT l.*, s.node_id AS id_source, t.node_id AS id_target
            FROM links l JOIN nodes s ON l.compound = s.compound AND l.source = s.name
                         JOIN nodes t ON l.compound = t.compound AND l.target = t.name"""),
        "concordance_status": _q(
            f"st AS (SELECT doc_id, quality, toxic, {STATUS.format(m='quality', v='toxic')} AS status FROM labels)",
            """codes AS (SELECT status, CAST(row_number() OVER (ORDER BY status) AS INTEGER) AS status_code
                  FROM (SELECT DISTINCT status FROM st WHERE status IS NOT NULL))""",
            body="SELECT st.doc_id, st.quality, st.toxic, st.status, codes.status_code FROM st LEFT JOIN codes ON st.status = codes.status"),
        "majority_vote": _q(SURVEY, body="SELECT variable, value, grp, count(*) AS n FROM al GROUP BY ALL"),
        "recode_labels": """SELECT d.doc_id, d.lang, r.lang_label, r.lang_rank FROM documents d
            LEFT JOIN (VALUES ('en', 'English', 1), ('de', 'German', 2), ('fr', 'French', 3), ('es', 'Spanish', 4))
                 r(lv, lang_label, lang_rank) ON d.lang = r.lv""",
        "factor_codes": """SELECT e.event_id, e.event_type, c.event_type_code FROM events e
            LEFT JOIN (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) AS INTEGER) AS event_type_code
                       FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)) c
              ON e.event_type = c.event_type""",
        "unique_uid": _q(f"vd AS ({_side(False)})", "g AS (SELECT uid, count(*) AS n FROM vd GROUP BY uid)", body="""
            SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) FILTER (WHERE n = 1) AS kept_rows,
                   CAST(sum(n) AS BIGINT) - count(*) FILTER (WHERE n = 1) AS removed_rows FROM g"""),
        "unify_sources": sql_rounded(_q(UNIFIED, body="SELECT * FROM uni"), ["concentration", "quantity"]),
        "restack_sources": sql_rounded(_q(UNIFIED, RESTACKED, body="SELECT * FROM rs"), ["concentration", "quantity"]),
        "method_compare_same": sql_rounded(_q(
            UNIFIED, RESTACKED,
            """mw AS (SELECT day, compound, concentration, patient, plate_row, plate_col,
                      count(*) FILTER (WHERE ld = 'Live') AS live, count(*) FILTER (WHERE ld = 'Dead') AS dead
               FROM rs GROUP BY ALL)""",
            _normalised("proportion", source="mw"),
            body="""SELECT patient,
                CASE WHEN split_part(compound, '_', 1) = 'media' THEN 'Media' ELSE split_part(compound, '_', 1) END AS compound,
                concentration, day, n_wells, live_mean, live_sd, nlive, nlive_sd,
                CASE WHEN split_part(compound, '_', 2) = 'Imaging' THEN 'ML' ELSE split_part(compound, '_', 2) END AS assay
                FROM norm"""), ["concentration"] + NORM_COLS),
        "plate_background": sql_rounded(_q(PLATES, body="SELECT * FROM bgp"), ["concentration", "signal"]),
        "plate_normalised": sql_rounded(_q(PLATES, PLATE_NORM, treatments("pn", "pt"), body=f"""
            SELECT pn.*, t.treatment, t.treatment_rank FROM pn {_tjoin('pn', 'pt_o')}"""),
            ["concentration", "mean", "sd", "norm_mean", "norm_sd"]),
        "assay_concordance": sql_rounded(_q(*_concordance_ctes(), body="""
            SELECT conc.*, r.label, r.label_rank FROM conc
            LEFT JOIN (VALUES ('IRI_20', 'IRI 20µM', 1), ('IRI_60', 'IRI 60µM', 2), ('STA_5', 'STA 5µM', 3))
                 r(lv, label, label_rank) ON conc.treatment = r.lv"""), ["mean_sig", "mean_pa", "norm_media"]),
        "assay_fit": sql_rounded(_q(*_concordance_ctes(), body="""
            SELECT treatment, CAST(regr_count(mean_pa, norm_media) AS BIGINT) AS n_points,
                   regr_slope(mean_pa, norm_media) AS slope, regr_intercept(mean_pa, norm_media) AS intercept,
                   regr_r2(mean_pa, norm_media) AS r2
            FROM conc WHERE norm_media BETWEEN 0 AND 1 AND mean_pa BETWEEN 0 AND 1 GROUP BY treatment"""),
            ["slope", "intercept", "r2"]),
        "assay_fit_censored": sql_rounded(_q(*_concordance_ctes(), body="""
            SELECT treatment, count(*) AS all_points, f.* EXCLUDE (treatment)
            FROM conc LEFT JOIN (
              SELECT treatment, CAST(regr_count(mean_pa, x) AS BIGINT) AS n_points, regr_slope(mean_pa, x) AS slope,
                     regr_intercept(mean_pa, x) AS intercept, regr_r2(mean_pa, x) AS r2
              FROM (SELECT treatment, mean_pa, norm_media * 2 AS x FROM conc) c
              WHERE x BETWEEN 0 AND 1 AND mean_pa BETWEEN 0 AND 1 GROUP BY treatment) f USING (treatment)
            GROUP BY ALL"""), ["slope", "intercept", "r2"]),
        "change_extents": sql_rounded(_q(PLATES, PLATE_NORM, """g AS (
            SELECT compound, max(norm_mean - 1 + norm_sd) AS hi, min(norm_mean - 1 - norm_sd) AS lo, count(DISTINCT day) AS n_days
            FROM pn GROUP BY compound)""", body="""
            SELECT compound, CASE WHEN clamp THEN 0.0 ELSE floor(CASE WHEN lo > 0 THEN 0.0 ELSE lo END) END::DOUBLE AS y_min,
                   CASE WHEN hi < 2 THEN round_even(hi, 1) ELSE CAST(ceil(hi) AS DOUBLE) END AS y_max,
                   CAST(n_days AS INTEGER) AS n_days, clamp
            FROM g, (VALUES (true), (false)) r(clamp)"""), ["y_min", "y_max"]),
        "assay_points": sql_rounded(_q(*_concordance_ctes(), body="""
            SELECT treatment, min(norm_media) AS norm_media, avg(mean_pa) AS mean_y, count(*) AS n
            FROM conc WHERE norm_media BETWEEN 0 AND 1 AND mean_pa BETWEEN 0 AND 1
            GROUP BY treatment, round(norm_media, 9)"""),
            ["norm_media", "mean_y"]),
        "plate_grid": sql_rounded("""
            SELECT concat(CAST(vec_id AS VARCHAR), format('{:02d}', i)) AS well, vec_id AS plate_row, i AS plate_col, signal
            FROM (SELECT vec_id, unnest(generate_series(1, len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS signal
                  FROM embeddings) e""", ["signal"]),
    }
