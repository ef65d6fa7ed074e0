import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every awkward kind, with columns whose names clash with the operators' own."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    base = " ".join(word[(i * i + 3 * i) % 24] + str(i % 13) for i in range(120))
    near = base.replace("beta4", "BETA4").replace("pi10", "changed")
    texts = [base, base, near, near + " one two three", None, "", "  \t\n ", "one", "one two", "One Two", "a b c d e", "A B C D E", "x " * 20_000, base + " " + " ".join(reversed(word)), "é́ \U0001f600 \x00 end", "b " + base, base.upper()]
    rows = [(i, t, ["en", "fr", None][i % 3], "src0", len(t or ""), "shared", 7) for i, t in enumerate(texts)]
    rows += [(0, base, "en", "src0", 1, "shared", 7), (None, "no id at all", "en", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shared string, n long")
