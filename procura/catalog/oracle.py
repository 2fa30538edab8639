"""DuckDB SQL twins of the registered queries, over the same Parquet tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

# Fixed values, as in the schema module.
MONTHS = (
    "['JANEIRO','FEVEREIRO','MARCO','ABRIL','MAIO','JUNHO',"
    "'JULHO','AGOSTO','SETEMBRO','OUTUBRO','NOVEMBRO','DEZEMBRO']"
)
SHORT = "['Jan','Fev','Mar','Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez']"
NAMES = ["JANEIRO", "FEVEREIRO", "MARCO", "ABRIL", "MAIO", "JUNHO", "JULHO", "AGOSTO", "SETEMBRO", "OUTUBRO", "NOVEMBRO", "DEZEMBRO"]


def words(x: str) -> str:
    """First two words."""
    return rf"array_to_string(regexp_split_to_array(trim({x}), '\s+')[1:2], ' ')"


def he(x: str, digits: int = 2) -> str:
    scale = float(10**digits)
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


PART_NAME = "upper(concat_ws(' ', p_name, p_type))"
LINES = """
linhas AS (
  SELECT year(l_shipdate)::INTEGER AS ANO, month(l_shipdate)::INTEGER AS MES_NUM, (n_regionkey + 1)::INTEGER AS FILIAL,
         l_suppkey, l_partkey, l_returnflag, l_discount, l_extendedprice::DECIMAL(18,2) AS VALOR
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""
FATO = f"""WITH {LINES.strip()},
fato AS (
  SELECT ANO, FILIAL, l_suppkey AS CODFORNEC, upper(s_name) AS FORNECEDOR, upper(s_name) AS FANTASIA,
         upper(n_name) AS CODCOMPRADOR, {MONTHS}[MES_NUM] AS MES, MES_NUM, VALOR, make_date(ANO, MES_NUM, 1) AS DATA
  FROM (SELECT ANO, MES_NUM, FILIAL, l_suppkey, sum(VALOR)::DECIMAL(18,2) AS VALOR FROM linhas GROUP BY ALL)
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""
FATO_PART = f"""WITH {LINES.strip()},
fato AS (
  SELECT ANO, FILIAL, l_partkey AS CODFORNEC, {PART_NAME} AS FORNECEDOR, {words(PART_NAME)} AS FANTASIA,
         upper(p_brand) AS CODCOMPRADOR, {MONTHS}[MES_NUM] AS MES, MES_NUM, VALOR, make_date(ANO, MES_NUM, 1) AS DATA
  FROM (SELECT ANO, MES_NUM, FILIAL, l_partkey, sum(VALOR)::DECIMAL(18,2) AS VALOR FROM linhas GROUP BY ALL)
  JOIN part ON p_partkey = l_partkey)"""
FILTER = """,
filtrado AS (
  SELECT * FROM fato WHERE ANO IN (1998, 1999, 2000) AND FILIAL IN (1, 2, 4)
  AND regexp_extract(CODCOMPRADOR, '[0-9]+$')::INTEGER < 18
  AND MES IN ('JANEIRO','FEVEREIRO','MARCO','ABRIL','JULHO','DEZEMBRO'))"""
FILTRADO = FATO + FILTER
TUDO = FATO + ", filtrado AS (SELECT * FROM fato)"


def mode(column: str, source: str = "fato") -> str:
    """Most frequent non-null value per CODFORNEC, the smallest on a tie."""
    return f"""(SELECT CODFORNEC, {column} AS v FROM (
      SELECT CODFORNEC, {column}, row_number() OVER (PARTITION BY CODFORNEC ORDER BY count(*) DESC, {column}) AS r
      FROM {source} WHERE {column} IS NOT NULL GROUP BY CODFORNEC, {column}) WHERE r = 1)"""


def dim(source: str = "fato") -> str:
    return f""",
dim AS (
  SELECT k.CODFORNEC, coalesce(f.v, '') AS FORNECEDOR,
         CASE WHEN coalesce(t.v, '') IN ('', 'NAN', 'NONE') THEN {words("coalesce(f.v, '')")} ELSE t.v END AS FANTASIA, N_REGISTROS
  FROM (SELECT CODFORNEC, count(*) AS N_REGISTROS FROM {source} GROUP BY CODFORNEC) k
  LEFT JOIN {mode("FORNECEDOR", source)} f USING (CODFORNEC) LEFT JOIN {mode("FANTASIA", source)} t USING (CODFORNEC))"""


def comp(a: int, b: int, years: list[int] | None = None) -> str:
    years = years or [a, b]
    sums = ", ".join(f"coalesce(sum(VALOR) FILTER (ANO = {y})::DOUBLE, 0) AS t{y}" for y in years)
    cols = ", ".join(f"{he(f't{y}')} AS TOTAL_{y}" for y in years)
    return f""",
comp AS (
  SELECT CODFORNEC, {cols}, {he(f"t{b} - t{a}")} AS VAR_ABS, {he("pct")} AS VAR_PCT,
    CASE WHEN t{a} = 0 AND t{b} > 0 THEN 'NOVO' WHEN t{b} = 0 AND t{a} > 0 THEN 'PERDIDO' WHEN pct IS NULL THEN 'INDEFINIDO'
         WHEN abs(pct) < 5 THEN 'ESTAVEL' WHEN pct > 0 THEN 'CRESCENTE' ELSE 'DECRESCENTE' END AS STATUS
  FROM (SELECT *, CASE WHEN t{a} > 0 THEN (t{b} / t{a} - 1) * 100 END AS pct
        FROM (SELECT CODFORNEC, {sums} FROM fato GROUP BY CODFORNEC)))"""


# --- sources, cleaning, reshape -------------------------------------------------------------

_wide = ", ".join(f"sum(VALOR) FILTER (MES_NUM = {i + 1})::DOUBLE AS {m}" for i, m in enumerate(NAMES))
IDS = "ANO, FILIAL, CODFORNEC, FORNECEDOR, FANTASIA, CODCOMPRADOR"
SQL["wide_scan"] = f"{FATO} SELECT {IDS}, {_wide} FROM fato GROUP BY {IDS}"
SQL["ingest_union"] = f"""{FATO} SELECT ANO, FILIAL, count(*) AS N_VALORES, count(DISTINCT CODFORNEC) AS N_FORNECEDORES,
  sum(VALOR)::DOUBLE AS TOTAL FROM fato GROUP BY ALL"""
SQL["source_contract"] = f"""{FATO}
SELECT 'COMPRAS ' || ANO AS WORKBOOK, 0 AS ORDEM, 'OK' AS NIVEL, n || ' linhas em 5 abas' AS MENSAGEM, n AS LINHAS, 17 AS COLUNAS,
  CASE WHEN ANO >= 2000 THEN ANO END AS ANO, true AS OK
FROM (SELECT ANO, count(DISTINCT (FILIAL, CODFORNEC)) AS n FROM fato GROUP BY ANO)"""
SQL["year_from_name"] = """SELECT doc_id, y AS ANO, y IS NOT NULL AS TEM_ANO FROM (
  SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(20[0-9]{2})', 1), '') AS INTEGER) AS y FROM documents)"""
_types = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
SQL["table_profile"] = " UNION ALL ".join(
    f"SELECT '{c}' AS COLUNA, '{t}' AS TIPO, count(*) AS N_LINHAS, count(*) - count({c}) AS N_NULOS FROM lineitem"
    for c, t in _types.items()
)
SQL["branch_mismatch"] = f"""{FATO} SELECT ANO, FILIAL, CODFORNEC, 'FILIAL ' || (n_regionkey + 1) AS SHEET, count(*) AS N
FROM fato JOIN supplier ON s_suppkey = CODFORNEC JOIN nation ON n_nationkey = s_nationkey
WHERE FILIAL IS DISTINCT FROM n_regionkey + 1 GROUP BY ALL"""
_dirty = r"""sujo AS (SELECT p_partkey,
  CASE WHEN p_size <= 3 THEN '' WHEN p_size <= 6 THEN ' nan ' WHEN p_size <= 9 THEN 'None' WHEN p_size <= 12 THEN '<NA>'
       WHEN p_size <= 15 THEN NULL ELSE '  ' || p_name || ' ' || chr(9) END AS t,
  CASE WHEN p_size <= 2 THEN 'none' ELSE concat_ws('  ', ' ', p_name, p_type, p_brand) END AS f FROM part),
limpo AS (SELECT p_partkey, CASE WHEN a NOT IN ('', 'NAN', 'NONE', '<NA>') THEN a END AS FANTASIA,
  CASE WHEN b NOT IN ('', 'NAN', 'NONE', '<NA>') THEN b END AS FORNECEDOR FROM (
  SELECT p_partkey, upper(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS a, upper(regexp_replace(f, '^\s+|\s+$', '', 'g')) AS b FROM sujo))"""
SQL["clean_strings"] = f"WITH {_dirty} SELECT * FROM limpo"
SQL["name_fallback"] = f"WITH {_dirty} SELECT p_partkey, coalesce(FANTASIA, {words('FORNECEDOR')}) AS FANTASIA, FORNECEDOR FROM limpo"
SQL["coerce_numeric"] = r"""WITH cru AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE l_linenumber WHEN 1 THEN '  ' || p || ' ' WHEN 2 THEN p || 'e1' WHEN 3 THEN replace(p, '.', ',') WHEN 4 THEN 'R$ ' || p
    WHEN 5 THEN 'nan' WHEN 6 THEN '' ELSE '-' || p END AS RAW
  FROM (SELECT *, l_extendedprice::DECIMAL(18,2)::VARCHAR AS p FROM lineitem))
SELECT *, CASE WHEN isfinite(TRY_CAST(RAW AS DOUBLE)) THEN TRY_CAST(RAW AS DOUBLE) END AS VALOR FROM cru"""
SQL["unpivot_months"] = f"""{FATO}, larga AS (SELECT {IDS}, {_wide} FROM fato GROUP BY {IDS})
SELECT ANO, FILIAL, CODFORNEC, MES, list_position({MONTHS}, MES)::INTEGER AS MES_NUM, VALOR
FROM larga UNPIVOT (VALOR FOR MES IN ({', '.join(NAMES)}))"""
SQL["drop_empty_months"] = f"""{FATO}, z AS (SELECT * REPLACE (CASE WHEN MES_NUM = ANO - 1994 THEN 0 ELSE VALOR END AS VALOR) FROM fato)
SELECT ANO, FILIAL, CODFORNEC, MES, MES_NUM, VALOR::DOUBLE AS VALOR FROM z
WHERE (ANO, MES) NOT IN (SELECT (ANO, MES) FROM z GROUP BY ANO, MES HAVING sum(VALOR) <= 0)"""
SQL["fact_build"] = SQL["fact_from_wide"] = f"{FATO} SELECT * REPLACE (VALOR::DOUBLE AS VALOR) FROM fato"
SQL["pivot_supplier_year"] = f"{FATO} SELECT CODFORNEC, " + ", ".join(
    f"coalesce(sum(VALOR) FILTER (ANO = {y})::DOUBLE, 0) AS TOTAL_{y}" for y in range(1995, 2002)
) + " FROM fato GROUP BY CODFORNEC"
SQL["pivot_year_branch"] = f"{FATO} SELECT ANO, " + ", ".join(
    he(f"sum(VALOR) FILTER (FILIAL = {b})::DOUBLE") + f" AS FILIAL_{b}" for b in range(1, 6)
) + " FROM fato GROUP BY ANO"
SQL["pivot_branch_month"] = f"{FATO} SELECT FILIAL, {_wide} FROM fato GROUP BY FILIAL"

# --- filters and lists ----------------------------------------------------------------------

SQL["filtered_fact"] = f"{FILTRADO} SELECT * REPLACE (VALOR::DOUBLE AS VALOR) FROM filtrado"
SQL["canonical_names"] = f"""{FATO_PART}{dim()} SELECT ANO, FILIAL, CODFORNEC, MES_NUM, dim.FORNECEDOR, dim.FANTASIA,
  VALOR::DOUBLE AS VALOR FROM fato JOIN dim USING (CODFORNEC)"""
SQL["filter_options"] = f"""{FATO} SELECT DISTINCT 'ANO' AS FILTRO, ANO::VARCHAR AS OPCAO FROM fato
UNION ALL SELECT DISTINCT 'FILIAL', FILIAL::VARCHAR FROM fato UNION ALL SELECT DISTINCT 'CODCOMPRADOR', CODCOMPRADOR FROM fato"""
SQL["supplier_labels"] = f"{FATO}{dim()} SELECT CODFORNEC, FANTASIA || '  ·  ' || CODFORNEC AS LABEL FROM dim"
SQL["active_months"] = f"""{FATO} SELECT i::INTEGER AS MES_NUM, {MONTHS}[i] AS MES, {SHORT}[i] AS MES_LBL,
  i IN (SELECT MES_NUM FROM fato) AS ATIVO FROM range(1, 13) t(i)"""
SQL["new_lost_suppliers"] = f"{FATO_PART}{comp(1999, 2000)} SELECT CODFORNEC, STATUS FROM comp WHERE STATUS IN ('NOVO', 'PERDIDO')"

# --- aggregations ---------------------------------------------------------------------------

SQL["kpis"] = f"""{TUDO} SELECT sum(VALOR)::DOUBLE AS TOTAL_GERAL, count(DISTINCT CODFORNEC) AS N_FORNECEDORES,
  sum(VALOR)::DOUBLE / count(DISTINCT CODFORNEC) AS MEDIA_FORNECEDOR,
  sum(VALOR)::DOUBLE / count(DISTINCT (ANO, MES, FILIAL)) AS TICKET_MEDIO FROM filtrado"""
SQL["consolidated"] = f"""{FATO} SELECT {IDS}, {he("sum(VALOR)::DOUBLE")} AS TOTAL_TRI,
  {he("sum(VALOR)::DOUBLE / count(VALOR)")} AS MEDIA_MENSAL, {he("coalesce(stddev_samp(VALOR::DOUBLE), 0)")} AS DESVIO,
  {he("min(VALOR)::DOUBLE")} AS MIN_MES, {he("max(VALOR)::DOUBLE")} AS MAX_MES, sum(VALOR) = 0 AS INATIVO_TRIMESTRE
  FROM fato GROUP BY {IDS}"""
_renamed = f"""WITH {LINES.strip()}, nomes AS (
  SELECT l_suppkey AS CODFORNEC, {PART_NAME} AS FORNECEDOR,
    CASE WHEN NOT starts_with({words(PART_NAME)}, 'RED') THEN {words(PART_NAME)} END AS FANTASIA
  FROM linhas JOIN part ON p_partkey = l_partkey)"""
SQL["supplier_dim"] = f"{_renamed}{dim('nomes')} SELECT * FROM dim"
SQL["yoy_status"] = f"{FATO_PART}{comp(1999, 2000)} SELECT * FROM comp"
SQL["yoy_status_suppliers"] = f"{FATO}{comp(2000, 2001, list(range(1995, 2002)))} SELECT * FROM comp"
SQL["year_supplier_stats"] = f"""{FATO}{dim()} SELECT CODFORNEC, {he("sum(VALOR)::DOUBLE / count(VALOR)")} AS MEDIA_MENSAL,
  {he("sum(VALOR)::DOUBLE")} AS TOTAL, {he("stddev_samp(VALOR::DOUBLE)")} AS DESVIO, dim.FANTASIA AS FANTASIA
  FROM fato JOIN dim USING (CODFORNEC) WHERE ANO = 2000 GROUP BY CODFORNEC, dim.FANTASIA"""
_rank = """,
rank AS (SELECT *, CASE WHEN MEDIA_MENSAL > 0 THEN DESVIO / MEDIA_MENSAL ELSE 0 END * 100 AS CV_PCT FROM (
  SELECT CODFORNEC, FANTASIA, sum(VALOR)::DOUBLE AS TOTAL, sum(VALOR)::DOUBLE / count(VALOR) AS MEDIA_MENSAL,
    coalesce(stddev_samp(VALOR::DOUBLE), 0) AS DESVIO, count(*) AS N_REGISTROS FROM filtrado GROUP BY CODFORNEC, FANTASIA))"""
SQL["supplier_ranking"] = f"""{TUDO}{_rank} SELECT CODFORNEC, FANTASIA, TOTAL, {he("MEDIA_MENSAL")} AS MEDIA_MENSAL,
  {he("DESVIO")} AS DESVIO, N_REGISTROS, {he("CV_PCT")} AS CV_PCT FROM rank"""
SQL["sum_branch_year"] = f"""{TUDO} SELECT FILIAL, ANO, sum(VALOR)::DOUBLE AS VALOR, 'Filial ' || FILIAL AS FILIAL_LBL
  FROM filtrado GROUP BY FILIAL, ANO"""
SQL["sum_month_year"] = f"""{TUDO} SELECT MES_NUM, ANO, sum(VALOR)::DOUBLE AS VALOR, {SHORT}[MES_NUM] AS MES_LBL
  FROM filtrado GROUP BY MES_NUM, ANO"""
SQL["heat_branch_month_year"] = f"""{TUDO} SELECT FILIAL, MES_NUM, ANO, sum(VALOR)::DOUBLE AS VALOR,
  'Filial ' || FILIAL AS FILIAL_LBL, {SHORT}[MES_NUM] AS MES_LBL FROM filtrado GROUP BY FILIAL, MES_NUM, ANO"""
SQL["monthly_series"] = f"""{FATO} SELECT DATA, ANO, MES_NUM, sum(VALOR)::DOUBLE AS VALOR, {SHORT}[MES_NUM] AS MES_LBL
  FROM fato GROUP BY DATA, ANO, MES_NUM"""
SQL["seasonality_index"] = f"""{FATO}, m AS (SELECT FILIAL, MES_NUM, sum(VALOR) AS v FROM fato GROUP BY ALL)
SELECT FILIAL, 'Filial ' || FILIAL AS FILIAL_LBL, MES_NUM, {SHORT}[MES_NUM] AS MES_LBL, v::DOUBLE AS VALOR,
  {he("v::DOUBLE / (sum(v) OVER (PARTITION BY FILIAL)::DOUBLE / count(*) OVER (PARTITION BY FILIAL))", 3)} AS INDICE FROM m"""
SQL["yoy_headline"] = f"""{FATO}, t AS (SELECT sum(VALOR) FILTER (ANO = 1999)::DOUBLE AS a, sum(VALOR) FILTER (ANO = 2000)::DOUBLE AS b FROM fato)
SELECT a AS TOTAL_A, b AS TOTAL_B, {he("(b / a - 1) * 100")} AS VAR_PCT, CASE WHEN b >= a THEN 'up' ELSE 'down' END AS DIRECAO,
  CASE WHEN b >= a THEN '+' ELSE '' END || format('{{:.1f}}', (b / a - 1) * 100) || '% vs 1999' AS TEXTO FROM t"""
_m = {i: f"coalesce(sum(VALOR) FILTER (MES_NUM = {i})::DOUBLE / count(VALOR) FILTER (MES_NUM = {i}), 0) AS m{i}" for i in range(1, 13)}
_feat = f""",
nome AS (SELECT CODFORNEC, FANTASIA FROM (SELECT CODFORNEC, FANTASIA,
  row_number() OVER (PARTITION BY CODFORNEC ORDER BY ANO, FILIAL, MES_NUM) AS r FROM fato WHERE FANTASIA IS NOT NULL) WHERE r = 1),
base AS (SELECT CODFORNEC, sum(VALOR)::DOUBLE AS TOTAL, sum(VALOR)::DOUBLE / count(VALOR) AS MEDIA,
  coalesce(stddev_samp(VALOR::DOUBLE), 0) AS DESVIO, count(DISTINCT FILIAL) AS N_FILIAIS, count(*) AS N_OBS,
  coalesce(sum(VALOR) FILTER (ANO = 1999)::DOUBLE, 0) AS T1999, coalesce(sum(VALOR) FILTER (ANO = 2000)::DOUBLE, 0) AS T2000,
  {', '.join(_m.values())} FROM fato GROUP BY CODFORNEC),
feat AS (SELECT CODFORNEC, FANTASIA, TOTAL, MEDIA, DESVIO, N_FILIAIS, N_OBS,
  CASE WHEN MEDIA > 0 THEN DESVIO / MEDIA ELSE 0 END AS CV, T1999, T2000, CASE WHEN T1999 > 0 THEN T2000 / T1999 - 1 ELSE 0 END AS GROWTH_YOY,
  {', '.join(f'm{i} / d AS SAZ_M{i}' for i in range(1, 13))}
  FROM (SELECT *, CASE WHEN s = 0 THEN 1 ELSE s END AS d FROM (
    SELECT *, ({' + '.join(f'm{i}' for i in range(1, 13))}) / (SELECT count(DISTINCT MES_NUM) FROM fato) AS s FROM base))
  LEFT JOIN nome USING (CODFORNEC))"""
_feat_cols = [f"SAZ_M{i}" for i in range(1, 13)]
SQL["supplier_features"] = f"""{FATO}{_feat} SELECT CODFORNEC, FANTASIA, TOTAL, {he("MEDIA", 4)} AS MEDIA, {he("DESVIO", 4)} AS DESVIO,
  N_FILIAIS, N_OBS, {he("CV", 4)} AS CV, T1999, T2000, {he("GROWTH_YOY", 4)} AS GROWTH_YOY,
  {', '.join(f'{he(c, 4)} AS {c}' for c in _feat_cols)} FROM feat"""
_scale_cols = [*_feat_cols, "CV", "GROWTH_YOY", "TOTAL", "MEDIA"]
SQL["scaled_features"] = f"{FATO}{_feat} SELECT CODFORNEC, " + ", ".join(
    he(f"coalesce(({c} - (SELECT avg({c}) FROM feat)) / (SELECT CASE WHEN min({c}) <> max({c}) THEN stddev_pop({c}) END FROM feat), 0)", 4) + f" AS {c}"
    for c in _scale_cols
) + " FROM feat"


def abc(source: str, keys: str) -> str:
    order = ", ".join(f"{k}" for k in keys.split(", "))
    return f""",
abc AS (SELECT {keys}, POSICAO, VALOR, v / t * 100 AS PARTICIPACAO_PCT, c / t * 100 AS ACUM_PCT,
  CASE WHEN c / t * 100 <= 80 THEN 'A' WHEN c / t * 100 <= 95 THEN 'B' ELSE 'C' END AS CLASSE
  FROM (SELECT {keys}, row_number() OVER (ORDER BY s DESC, {order}) AS POSICAO, s::DOUBLE AS VALOR, s::DOUBLE AS v, sum(s) OVER ()::DOUBLE AS t,
          sum(s) OVER (ORDER BY s DESC, {order} ROWS UNBOUNDED PRECEDING)::DOUBLE AS c
        FROM (SELECT {keys}, sum(VALOR) AS s FROM {source} GROUP BY {keys})))"""


SQL["abc_curve"] = f"{FATO}{dim()}{abc('fato', 'CODFORNEC')} SELECT abc.*, dim.FANTASIA FROM abc JOIN dim USING (CODFORNEC)"
SQL["abc_curve_parts"] = f"{FATO_PART}{abc('fato', 'CODFORNEC, FANTASIA')} SELECT * FROM abc"
_abc_filtered = TUDO + abc("filtrado", "CODFORNEC, FANTASIA")
SQL["abc_summary"] = f"{_abc_filtered} SELECT CLASSE, count(*) AS N, sum(VALOR::DECIMAL(18,2))::DOUBLE AS VALOR FROM abc GROUP BY CLASSE"

SCOPES = """
  SELECT 'GERAL' AS ESCOPO, 'Total' AS CHAVE, * FROM fato
  UNION ALL SELECT 'ANO', ANO::VARCHAR, * FROM fato UNION ALL SELECT 'FILIAL', 'Filial ' || FILIAL, * FROM fato
  UNION ALL SELECT 'ANO_FILIAL', ANO || ' · Filial ' || FILIAL, * FROM fato"""
_growth = f""",
mensal AS (SELECT ESCOPO, CHAVE, ANO, MES_NUM, sum(VALOR)::DOUBLE AS v FROM escopos GROUP BY ALL),
passos AS (SELECT ESCOPO, CHAVE, v, lag(v) OVER (PARTITION BY ESCOPO, CHAVE ORDER BY ANO, MES_NUM) AS p FROM mensal),
cresc AS (SELECT ESCOPO, CHAVE, {he('''CASE WHEN count(*) > 1 THEN avg(CASE WHEN p <> 0 THEN v / p - 1 WHEN p = 0 AND v > 0 THEN 'inf'::DOUBLE
    WHEN p = 0 AND v < 0 THEN '-inf'::DOUBLE END) * 100 ELSE 0 END''')} AS CRESC_MEDIO_MOM_PCT FROM passos GROUP BY ALL)"""
_conc = f"""{FATO}, escopos AS ({SCOPES}){_growth},
forn AS (SELECT ESCOPO, CHAVE, CODFORNEC, sum(VALOR)::DOUBLE AS v FROM escopos GROUP BY ALL),
ordem AS (SELECT *, row_number() OVER (PARTITION BY ESCOPO, CHAVE ORDER BY v DESC, CODFORNEC) AS d,
  row_number() OVER (PARTITION BY ESCOPO, CHAVE ORDER BY v) AS a, count(*) OVER (PARTITION BY ESCOPO, CHAVE) AS n,
  sum(v) OVER (PARTITION BY ESCOPO, CHAVE) AS t FROM forn),
conc AS (SELECT ESCOPO, CHAVE, {he("max(t)")} AS TOTAL, count(*) FILTER (v > 0) AS N_FORNECEDORES,
  {he("sum(v) FILTER (d <= 5) / max(t) * 100")} AS TOP5_PCT, {he("sum(v) FILTER (d <= 10) / max(t) * 100")} AS TOP10_PCT,
  {he("sum((v / t * 100) ** 2)")} AS HHI, {he("(max(n) + 1 - 2 * sum((n + 1 - a) * v) / max(t)) / max(n)")} AS GINI
  FROM ordem GROUP BY ESCOPO, CHAVE),
metricas AS (SELECT * FROM conc JOIN cresc USING (ESCOPO, CHAVE))"""
SQL["concentration_scopes"] = f"{_conc} SELECT * FROM metricas"
SQL["concentration_bands"] = f"""{_conc} SELECT ESCOPO, CHAVE, HHI, CASE WHEN HHI > 2500 THEN 'alto' WHEN HHI > 1500 THEN 'moderado' ELSE 'baixo' END AS HHI_FAIXA,
  GINI, CASE WHEN GINI > 0.6 THEN 'alta' ELSE 'moderada' END AS GINI_FAIXA FROM metricas"""
SQL["monthly_growth"] = f"""{FATO.replace('fato AS (', 'fato0 AS (')},
fato AS (SELECT * REPLACE (CASE WHEN DATA = DATE '1997-05-01' THEN 0 ELSE VALOR END AS VALOR) FROM fato0),
escopos AS ({SCOPES}){_growth} SELECT * FROM cresc"""
SQL["lorenz_curve"] = f"""{FATO_PART}, s AS (SELECT CODFORNEC, sum(VALOR) AS v FROM fato GROUP BY CODFORNEC)
SELECT row_number() OVER w::DOUBLE / (SELECT count(*) FROM s) AS CUM_POP,
  sum(v) OVER (ORDER BY v, CODFORNEC ROWS UNBOUNDED PRECEDING)::DOUBLE / (SELECT sum(v)::DOUBLE FROM s) AS CUM_VAL
FROM s WINDOW w AS (ORDER BY v, CODFORNEC) UNION ALL SELECT 0, 0"""

# --- rankings -------------------------------------------------------------------------------

SQL["top_suppliers"] = f"""{FATO}{dim()} SELECT CODFORNEC, s.VALOR, POSICAO, dim.FANTASIA FROM (
  SELECT CODFORNEC, sum(VALOR)::DOUBLE AS VALOR, row_number() OVER (ORDER BY sum(VALOR) DESC, CODFORNEC)::INTEGER AS POSICAO FROM fato GROUP BY CODFORNEC ORDER BY sum(VALOR) DESC, CODFORNEC LIMIT 10) s JOIN dim USING (CODFORNEC)"""
SQL["top_n_total"] = f"""{TUDO}, s AS (SELECT CODFORNEC, FANTASIA, sum(VALOR) AS v FROM filtrado GROUP BY ALL)
SELECT count(*) AS EXIBIDOS, (SELECT count(*) FROM s) AS DE, sum(v)::DOUBLE AS TOTAL FROM (SELECT v FROM s ORDER BY v DESC, CODFORNEC, FANTASIA LIMIT 15)"""
for _name, _dir in (("top_growth", "DESC"), ("top_drop", "ASC")):
    SQL[_name] = f"""{FATO}{comp(1999, 2000)}{dim()} SELECT c.*, dim.FANTASIA FROM (
  SELECT *, row_number() OVER (ORDER BY VAR_ABS {_dir}, CODFORNEC)::INTEGER AS POSICAO FROM comp ORDER BY VAR_ABS {_dir}, CODFORNEC LIMIT 5) c JOIN dim USING (CODFORNEC)"""
SQL["top8_series"] = f"""{FATO} SELECT DATA, FANTASIA, sum(VALOR)::DOUBLE AS VALOR FROM fato WHERE CODFORNEC IN (
  SELECT CODFORNEC FROM fato GROUP BY CODFORNEC ORDER BY sum(VALOR) DESC, CODFORNEC LIMIT 8) GROUP BY DATA, FANTASIA"""
SQL["branch_composition"] = f"""{FATO}, top AS (SELECT FANTASIA FROM fato GROUP BY FANTASIA ORDER BY sum(VALOR) DESC, FANTASIA LIMIT 10)
SELECT 'Filial ' || FILIAL AS FILIAL_LBL, CASE WHEN FANTASIA IN (SELECT FANTASIA FROM top) THEN FANTASIA ELSE 'Outros' END AS GRUPO,
  sum(VALOR)::DOUBLE AS VALOR FROM fato GROUP BY ALL"""
ALVO = f"""(SELECT year(m)::INTEGER AS ANO, month(m)::INTEGER AS MES_NUM, {MONTHS}[month(m)] AS MES FROM (
  SELECT max(DATA) + INTERVAL 1 MONTH AS m FROM fato))"""
SQL["next_month"] = f"{FATO} SELECT * FROM {ALVO}"

# --- labels and display tables --------------------------------------------------------------


def brl(x: str, digits: int = 2) -> str:
    return f"coalesce('R$ ' || translate(format('{{:,.{digits}f}}', ({x})::DOUBLE), ',.', '.,'), '—')"


def short_brl(x: str) -> str:
    return f"""CASE WHEN abs({x}) >= 1e6 THEN 'R$ ' || replace(format('{{:,.2f}}', {x} / 1e6), '.', ',') || ' mi'
      WHEN abs({x}) >= 1e3 THEN 'R$ ' || replace(format('{{:,.1f}}', {x} / 1e3), '.', ',') || ' mil' ELSE {brl(x)} END"""


def pct(x: str, digits: int = 1) -> str:
    return rf"coalesce(regexp_replace({he(x, digits)}::DECIMAL(38,2)::VARCHAR, '(\.\d)0$', '\1'), 'nan') || '%'"


_brl = {"CENTESIMO": "o_totalprice / 10000", "INTEIRO": "o_totalprice", "MILHAR": "o_totalprice * 1000", "NEGATIVO": "-o_totalprice"}
SQL["fmt_brl"] = f"SELECT o_orderkey, {', '.join(f'{brl(n)} AS BRL_{n}, {short_brl(n)} AS CURTO_{n}' for n in _brl)} FROM (" \
    f"SELECT o_orderkey, {', '.join(f'{he(x)} AS {n}' for n, x in _brl.items())} FROM orders)"
_ENGLISH = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
SQL["month_labels"] = f"""{FATO} SELECT DISTINCT ANO, MES_NUM, MES, list_position({MONTHS}, MES)::INTEGER AS NUMERO, {SHORT}[MES_NUM] AS MES_LBL,
  {_ENGLISH}[MES_NUM] || '/' || ANO AS PERIODO, {SHORT}[MES_NUM] || '/' || ANO AS ALVO_LBL FROM fato"""
SQL["supplier_table"] = f"""{TUDO}{_rank} SELECT CODFORNEC, FANTASIA, {brl("TOTAL")} AS TOTAL_BRL, {brl(he("MEDIA_MENSAL"))} AS MEDIA_BRL,
  {brl(he("DESVIO"))} AS DESVIO_BRL, {pct("CV_PCT")} AS CV_TEXTO, N_REGISTROS AS N_LINHAS FROM rank"""
SQL["abc_table"] = f"""{_abc_filtered} SELECT CODFORNEC, FANTASIA, {brl("VALOR")} AS VALOR_BRL, {pct("PARTICIPACAO_PCT", 2)} AS PARTE_TEXTO,
  {pct("ACUM_PCT", 2)} AS SOMA_TEXTO, CLASSE FROM abc"""
SQL["comparison_table"] = f"""{FATO_PART}{comp(1999, 2000)}{dim()} SELECT CODFORNEC, FANTASIA, {brl("TOTAL_1999")} AS BRL_1999, {brl("TOTAL_2000")} AS BRL_2000,
  {brl("VAR_ABS")} AS DIF_BRL, {pct("VAR_PCT", 2)} AS DIF_TEXTO, STATUS FROM comp JOIN dim USING (CODFORNEC)"""
SQL["concentration_table"] = f"""{_conc} SELECT ESCOPO, CHAVE, {brl("TOTAL")} AS TOTAL_BRL, N_FORNECEDORES,
  {pct("TOP5_PCT")} AS TOP5_TEXTO, {pct("TOP10_PCT")} AS TOP10_TEXTO, round_even(HHI, 0)::BIGINT AS HHI, {he("GINI", 3)} AS GINI,
  {pct("CRESC_MEDIO_MOM_PCT", 2)} AS CRESC_TEXTO FROM metricas"""

# --- quality --------------------------------------------------------------------------------


def checks(wide: str, source: str) -> str:
    return f"""achados AS (
  SELECT 1 AS ORDEM, count(*) FILTER (VALOR IS NULL) AS N, ' linhas sem valor' AS m FROM {source}
  UNION ALL SELECT 2, count(*) FILTER (VALOR < 0), ' linhas com valor abaixo de zero' FROM {source}
  UNION ALL SELECT 3, count(*) - count(DISTINCT (ANO, FILIAL, CODFORNEC, MES)), ' linhas a mais por chave do fato' FROM {source}
  UNION ALL SELECT 4, count(*) - count(DISTINCT (ANO, FILIAL, CODFORNEC)), ' linhas a mais por fornecedor e filial' FROM {wide}),
resultado AS (SELECT ORDEM, 'ERRO' AS NIVEL, N, N || m AS MENSAGEM FROM achados WHERE N > 0
  UNION ALL SELECT 0, 'OK', 0, 'nada a corrigir' WHERE (SELECT sum(N) FROM achados) = 0)"""


SQL["dq_checks"] = f"""WITH {LINES.strip()}, razao AS (SELECT ANO, FILIAL, l_suppkey AS CODFORNEC, {MONTHS}[MES_NUM] AS MES,
  CASE WHEN l_discount = 0 THEN NULL WHEN l_returnflag = 'R' THEN -VALOR ELSE VALOR END AS VALOR FROM linhas),
larga AS (SELECT DISTINCT ANO, FILIAL, CODFORNEC, MES FROM razao), {checks('larga', 'razao')} SELECT * FROM resultado"""
_larga = "larga AS (SELECT DISTINCT ANO, FILIAL, CODFORNEC FROM fato)"
SQL["dq_checks_clean"] = f"{FATO}, {_larga}, {checks('larga', 'fato')} SELECT * FROM resultado"
SQL["qa_report"] = f"""{FATO_PART}{comp(1999, 2000)}, {_larga}, {checks('larga', 'fato')}
SELECT 'CONTAGENS' AS SECAO, 'linhas_fato' AS ITEM, count(*)::VARCHAR AS VALOR FROM fato
UNION ALL SELECT 'CONTAGENS', 'fornecedores', count(DISTINCT CODFORNEC)::VARCHAR FROM fato
UNION ALL SELECT 'CONTAGENS', 'linhas_consolidado', count(*)::VARCHAR FROM (SELECT DISTINCT {IDS} FROM fato)
UNION ALL SELECT DISTINCT 'FILIAIS', FILIAL::VARCHAR, NULL FROM fato UNION ALL SELECT DISTINCT 'ANOS', ANO::VARCHAR, NULL FROM fato
UNION ALL SELECT DISTINCT 'COMPRADORES', CODCOMPRADOR, NULL FROM fato
UNION ALL SELECT 'TOTAIS', ANO || '/' || FILIAL, format('{{:,.2f}}', {he("sum(VALOR)::DOUBLE")}) FROM fato GROUP BY ANO, FILIAL
UNION ALL SELECT 'VALIDACOES', NIVEL, MENSAGEM FROM resultado
UNION ALL SELECT 'STATUS', CODFORNEC::VARCHAR, STATUS FROM comp WHERE STATUS IN ('NOVO', 'PERDIDO')"""

# --- forecast -------------------------------------------------------------------------------


def projection(source: str, keys: str) -> str:
    """Least squares by the engine's own regression functions, the rest as weighted means."""
    return f""",
pos AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ANO, MES_NUM) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
mod0 AS (SELECT {keys}, max(n) AS n, max(VALOR::DOUBLE) FILTER (i = n - 1) AS naive, sum(VALOR)::DOUBLE / max(n) AS media,
  min(VALOR) <> max(VALOR) AS varia, regr_intercept(VALOR::DOUBLE, i) + max(n) * regr_slope(VALOR::DOUBLE, i) AS reta,
  sum(VALOR::DOUBLE * (1 + CASE WHEN n > 1 THEN i / (n - 1)::DOUBLE ELSE 0 END)) / sum(1 + CASE WHEN n > 1 THEN i / (n - 1)::DOUBLE ELSE 0 END) AS media_pond,
  stddev_pop(VALOR::DOUBLE) AS dp FROM pos GROUP BY {keys}),
mod1 AS (SELECT *, CASE WHEN n >= 2 AND varia THEN greatest(0, reta) ELSE naive END AS tendencia FROM mod0),
mod2 AS (SELECT *, (naive + media + tendencia + media_pond) / 4 AS c FROM mod1),
mod3 AS (SELECT *, sqrt(((naive - c) ** 2 + (media - c) ** 2 + (tendencia - c) ** 2 + (media_pond - c) ** 2) / 4) AS d FROM mod2),
mod4 AS (SELECT *, greatest(d, 0.5 * CASE WHEN n >= 2 THEN dp ELSE d END) AS s FROM mod3),
proj AS (SELECT {keys}, naive, media, tendencia, media_pond, greatest(0, c) AS ensemble, greatest(0, c - 1.5 * s) AS ic_inf, c + 1.5 * s AS ic_sup, s AS std FROM mod4)"""


_proj = ", ".join(f"{he(c)} AS {c}" for c in ("naive", "media", "tendencia", "media_pond", "ensemble", "ic_inf", "ic_sup", "std"))
SQL["forecast_series"] = f"{FATO}{projection('fato', 'FILIAL, CODFORNEC, FANTASIA')} SELECT FILIAL, CODFORNEC, FANTASIA, {_proj}, a.* FROM proj, {ALVO} a"
_total = FATO + """, soma AS (
  SELECT 'FILIAL' AS ESCOPO, 'Filial ' || FILIAL AS CHAVE, FILIAL, ANO, MES_NUM, sum(VALOR) AS VALOR FROM fato GROUP BY ALL
  UNION ALL SELECT 'GERAL', 'TOTAL', -1, ANO, MES_NUM, sum(VALOR) FROM fato GROUP BY ALL)""" + projection("soma", "ESCOPO, CHAVE, FILIAL")
SQL["forecast_total"] = f"""{_total} SELECT ESCOPO, CHAVE, FILIAL, {_proj}, {he("ic_sup - ensemble")} AS ERRO_SUP, {he("ensemble - ic_inf")} AS ERRO_INF,
  a.ANO, a.MES_NUM FROM proj, {ALVO} a"""
SQL["history_plus_forecast"] = f"""{_total}, h AS (SELECT DATA, sum(VALOR)::DOUBLE AS v FROM fato GROUP BY DATA)
SELECT 'HISTORICO' AS TIPO, DATA, {he("v")} AS VALOR, NULL::DOUBLE AS IC_INF, NULL::DOUBLE AS IC_SUP FROM h
UNION ALL SELECT 'PREVISAO', DATA, {he("v")}, NULL, NULL FROM h WHERE DATA = (SELECT max(DATA) FROM h)
UNION ALL SELECT 'PREVISAO', make_date(a.ANO, a.MES_NUM, 1), {he("ensemble")}, {he("ic_inf")}, {he("ic_sup")} FROM proj, {ALVO} a WHERE ESCOPO = 'GERAL'"""


def lags(mean: str) -> str:
    return f"""SELECT ANO, CODFORNEC, VALOR::DOUBLE AS VALOR, FILIAL, dense_rank() OVER (ORDER BY CODFORNEC) - 1 AS FORNEC_CODE, MES_NUM,
  coalesce(lag(VALOR::DOUBLE) OVER w, 0) AS LAG_1, {he(mean)} AS MEDIA_HIST FROM fato WINDOW w AS (PARTITION BY FILIAL, CODFORNEC ORDER BY ANO, MES_NUM)"""


_w = "(PARTITION BY FILIAL, CODFORNEC ORDER BY ANO, MES_NUM ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
_now, _past = _w.format("CURRENT ROW"), _w.format("1 PRECEDING")
SQL["lag_features"] = f"{FATO} {lags(f'sum(VALOR) OVER {_now}::DOUBLE / count(*) OVER {_now}')}"
SQL["lag_features_strict"] = f"{FATO_PART} {lags(f'coalesce(sum(VALOR) OVER {_past}::DOUBLE / count(*) OVER {_past}, 0)')}"
SQL["last_observation"] = f"""{FATO} SELECT FILIAL, CODFORNEC, ANO, MES_NUM, VALOR::DOUBLE AS VALOR FROM fato
  QUALIFY row_number() OVER (PARTITION BY FILIAL, CODFORNEC ORDER BY ANO DESC, MES_NUM DESC) = 1"""

# --- anomalies ------------------------------------------------------------------------------

_z = FATO + """,
est AS (SELECT CODFORNEC, sum(VALOR)::DOUBLE / count(VALOR) AS MEDIA_FORN, coalesce(stddev_samp(VALOR::DOUBLE), 0) AS STD_FORN FROM fato GROUP BY CODFORNEC),
z AS (SELECT *, abs(Z_SCORE) > 2 AS ANOMALIA_Z FROM (
  SELECT fato.*, MEDIA_FORN, STD_FORN, CASE WHEN STD_FORN > 0 THEN (VALOR::DOUBLE - MEDIA_FORN) / STD_FORN ELSE 0 END AS Z_SCORE FROM fato JOIN est USING (CODFORNEC)))"""
SQL["zscore_anomalies"] = f"""{_z} SELECT ANO, FILIAL, CODFORNEC, MES_NUM, VALOR::DOUBLE AS VALOR, {he("MEDIA_FORN", 4)} AS MEDIA_FORN,
  {he("STD_FORN", 4)} AS STD_FORN, {he("Z_SCORE", 4)} AS Z_SCORE, ANOMALIA_Z FROM z"""
SQL["zscore_summary"] = f"""{_z} SELECT count(*) AS N_OBS, count(*) FILTER (ANOMALIA_Z) AS N_ANOMALIAS_Z,
  {he("count(*) FILTER (ANOMALIA_Z) / count(*)::DOUBLE * 100", 4)} AS PCT_Z FROM z"""
SQL["zscore_histogram"] = f"""{_z} SELECT f AS FAIXA, count(*) AS N, -4.0::DOUBLE + (f - 1) * 0.3::DOUBLE AS DE FROM (
  SELECT CASE WHEN Z_SCORE < -4 THEN 0 WHEN Z_SCORE >= 8 THEN 41 ELSE floor((Z_SCORE + 4) / 12 * 40) + 1 END::INTEGER AS f FROM z) GROUP BY f"""
SQL["top_anomalies"] = f"""{_z} SELECT 'Filial ' || FILIAL AS FILIAL_LBL, {_ENGLISH}[MES_NUM] || '/' || ANO AS PERIODO, CODFORNEC, FANTASIA, {brl("VALOR")} AS VALOR_BRL,
  {brl(he("MEDIA_FORN"))} AS MEDIA_BRL, {he("Z_SCORE")} AS Z, CASE WHEN ANOMALIA_Z THEN 'Z' ELSE '' END AS DETECTOR
  FROM (SELECT * FROM z ORDER BY abs(Z_SCORE) DESC, ANO, FILIAL, CODFORNEC, MES_NUM, VALOR LIMIT 30)"""

# --- rules that follow the models -------------------------------------------------------------

_final = FATO + projection("fato", "FILIAL, CODFORNEC, FANTASIA") + """,
r AS (SELECT FILIAL, CODFORNEC, max(VALOR)::DOUBLE / 2 AS RF_PREDICAO FROM fato WHERE CODFORNEC % 2 = 0 GROUP BY FILIAL, CODFORNEC),
fim AS (SELECT proj.*, RF_PREDICAO, CASE WHEN RF_PREDICAO IS NOT NULL THEN greatest(0, (ensemble + RF_PREDICAO) / 2) END AS PREDICAO_FINAL
  FROM proj LEFT JOIN r USING (FILIAL, CODFORNEC))"""
SQL["blend_rule"] = f"{_final} SELECT FILIAL, CODFORNEC, {he('RF_PREDICAO')} AS RF_PREDICAO, {he('PREDICAO_FINAL')} AS PREDICAO_FINAL FROM fim"
_sums = ", ".join(f"{he(f'sum({c})')} AS {c}" for c in ("ensemble", "ic_inf", "ic_sup"))
SQL["top_forecast_rule"] = f"""{_final} SELECT CODFORNEC, FANTASIA, {_sums}, {he("coalesce(sum(PREDICAO_FINAL), 0)")} AS PREDICAO_FINAL
FROM fim GROUP BY CODFORNEC, FANTASIA ORDER BY sum(ensemble) DESC, CODFORNEC, FANTASIA LIMIT 20"""
_region = FATO + _feat + """,
reg AS (SELECT feat.*, n_regionkey AS CLUSTER FROM feat JOIN supplier ON s_suppkey = CODFORNEC JOIN nation ON n_nationkey = s_nationkey),
perfil AS (SELECT *, CASE WHEN ORDEM = 0 THEN 'Estratégico (alto volume)' WHEN growth > 0.15 THEN 'Em crescimento' WHEN growth < -0.15 THEN 'Em retração'
    WHEN cv > 0.5 THEN 'Volátil' ELSE 'Cauda longa estável' END AS CLUSTER_ROTULO
  FROM (SELECT *, (row_number() OVER (ORDER BY total DESC, CLUSTER) - 1)::INTEGER AS ORDEM FROM (
    SELECT CLUSTER, avg(TOTAL) AS total, avg(CV) AS cv, avg(GROWTH_YOY) AS growth FROM reg GROUP BY CLUSTER)))"""
SQL["cluster_profile_rule"] = f"""{_region} SELECT CLUSTER, {he("total", 4)} AS total, {he("cv", 4)} AS cv, {he("growth", 4)} AS growth, ORDEM, CLUSTER_ROTULO FROM perfil"""
SQL["cluster_size_rule"] = f"""{_region} SELECT CLUSTER, CLUSTER_ROTULO, count(*) AS N FROM reg JOIN perfil USING (CLUSTER)
GROUP BY CLUSTER, CLUSTER_ROTULO ORDER BY N DESC, CLUSTER LIMIT 4"""
SQL["cluster_table_rule"] = f"""{_region} SELECT CLUSTER, CLUSTER_ROTULO, CODFORNEC, FANTASIA, {brl("reg.TOTAL")} AS TOTAL_BRL, {brl("MEDIA")} AS MEDIA_BRL,
  {he("reg.CV")} AS CV, {pct("GROWTH_YOY * 100")} AS CRESC_TEXTO FROM reg JOIN perfil USING (CLUSTER)"""
SQL["bubble_rule"] = f"""{_region} SELECT CODFORNEC, {he("least(greatest(TOTAL / (SELECT max(TOTAL) FROM reg) * 60 + 8, 8), 70)", 4)} AS TAMANHO FROM reg"""
SQL["detector_rule"] = f"""{_z} SELECT ANO, FILIAL, CODFORNEC, MES_NUM, ANOMALIA_Z OR MES_NUM = 12 AS ANOMALIA,
  CASE WHEN ANOMALIA_Z AND MES_NUM = 12 THEN 'Z+ISO' WHEN ANOMALIA_Z THEN 'Z' WHEN MES_NUM = 12 THEN 'ISO' ELSE '' END AS FLAG FROM z"""
SQL["detector_summary_rule"] = f"""{_z} SELECT count(*) FILTER (ANOMALIA_Z) AS N_ANOMALIAS_Z, count(*) FILTER (MES_NUM = 12) AS N_ANOMALIAS_ISO,
  count(*) FILTER (ANOMALIA_Z OR MES_NUM = 12) AS N_TOTAL, {he("avg((ANOMALIA_Z OR MES_NUM = 12)::INTEGER) * 100", 4)} AS PCT_TOTAL FROM z"""
SQL["percentile_flag"] = f"""{FATO}, corte AS (SELECT quantile_cont(VALOR::DOUBLE, 0.05) AS q FROM fato)
SELECT ANO, FILIAL, CODFORNEC, MES_NUM, {he("VALOR::DOUBLE - q")} AS ISO_SCORE, VALOR::DOUBLE - q < 0 AS ANOMALIA_ISO FROM fato, corte"""

# --- two loads: the result does not show how the rows came in --------------------------------

for _name in ("consolidated", "supplier_dim", "yoy_status", "dq_checks"):
    SQL[f"refresh_{_name}"] = SQL[_name]
SQL["active_months_by_year"] = f"""{FATO} SELECT a.ANO, i::INTEGER AS MES_NUM, {SHORT}[i] AS MES_LBL, count(fato.ANO) AS N,
  coalesce(sum(VALOR)::DOUBLE, 0) AS VALOR, count(fato.ANO) > 0 AS ATIVO
  FROM (SELECT DISTINCT ANO FROM fato) AS a CROSS JOIN range(1, 13) AS t(i) LEFT JOIN fato ON fato.ANO = a.ANO AND fato.MES_NUM = i GROUP BY a.ANO, i"""
