import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]


@pytest.fixture(scope="session")
def spark():
    from procura.session import local_session

    session = local_session("8", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_fact(spark):
    """Fact from (ANO, FILIAL, CODFORNEC, FANTASIA, MES_NUM, VALOR) rows."""
    from pyspark.sql import functions as F

    from procura.functions.labels import month_name
    from procura.schema import FACT_COLUMNS

    def make(rows):
        schema = "ANO int, FILIAL int, CODFORNEC long, FANTASIA string, MES_NUM int, v string"
        df = spark.createDataFrame(rows, schema)
        return (
            df.withColumn("VALOR", F.col("v").cast("decimal(18,2)"))
            .withColumn("FORNECEDOR", F.concat(F.col("FANTASIA"), F.lit(" LTDA")))
            .withColumn("CODCOMPRADOR", F.lit("C1"))
            .withColumn("MES", month_name(F.col("MES_NUM")))
            .withColumn("DATA", F.make_date("ANO", "MES_NUM", F.lit(1)))
            .select(*FACT_COLUMNS)
        )

    return make
