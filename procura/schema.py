"""Fixed names of the purchasing model: columns, months, labels, thresholds."""

from __future__ import annotations

# Results must carry exactly these names, words and cut points.
MONTHS = [
    "JANEIRO", "FEVEREIRO", "MARCO", "ABRIL", "MAIO", "JUNHO",
    "JULHO", "AGOSTO", "SETEMBRO", "OUTUBRO", "NOVEMBRO", "DEZEMBRO",
]
MONTH_LABELS = ["Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez"]
ID_COLUMNS = ["ANO", "FILIAL", "CODFORNEC", "FORNECEDOR", "FANTASIA", "CODCOMPRADOR"]
WIDE_COLUMNS = ID_COLUMNS + MONTHS
EXPECTED_SHEETS = ["FILIAL 1", "FILIAL 2", "FILIAL 3", "FILIAL 4"]
REQUIRED_COLUMNS = ["CODCOMPRADOR", "CODFORNEC", "FILIAL", "FORNECEDOR"]
NAME_ALIASES = ["REP_OBS", "NOME_FANTASIA", "NOME", "APELIDO"]
DERIVED_COLUMNS = ["TOTAL", "MEDIA"]
NULL_WORDS = ["", "NAN", "NONE", "<NA>"]
BLANK_NAMES = ["", "NAN", "NONE"]
STATUS_NEW, STATUS_LOST, STATUS_UNDEFINED = "NOVO", "PERDIDO", "INDEFINIDO"
STATUS_STABLE, STATUS_UP, STATUS_DOWN = "ESTAVEL", "CRESCENTE", "DECRESCENTE"
STABLE_PCT = 5
ABC_A, ABC_B = 80, 95
HHI_HIGH, HHI_MODERATE, GINI_HIGH = 2500, 1500, 0.6
OTHERS = "Outros"
CLUSTER_LABELS = {
    "strategic": "Estratégico (alto volume)",
    "growing": "Em crescimento",
    "shrinking": "Em retração",
    "volatile": "Volátil",
    "stable": "Cauda longa estável",
}
CLUSTER_GROWTH, CLUSTER_CV = 0.15, 0.5
Z_LIMIT = 2
CONTAMINATION = 0.05
SEED = 42

FACT_KEY = ["ANO", "FILIAL", "CODFORNEC", "MES"]
FACT_COLUMNS = ID_COLUMNS + ["MES", "MES_NUM", "VALOR", "DATA"]
FACT_ORDER = ["ANO", "FILIAL", "CODFORNEC", "MES_NUM"]
AMOUNT = "decimal(18,2)"
