"""Dockerfiles of the registered corpus, and lookups in them, by the short ways and by the long ones."""

import pytest
from pyspark.sql import functions as F

from codescope.operators import dockerfile
from workload import corpora


def test_texts_are_built_as_a_formatter_would(spark, tmp_path):
    keys = [(k, c, p) for k in (0, 1, 2, 3, 4, 5, 2**40, -1, -2, -3, None) for c, p in ((17, "1-URGENT"), (None, None), (-4, "%s"))]
    orders = spark.createDataFrame(keys, "o_orderkey long, o_custkey long, o_orderpriority string")
    orders.write.parquet(str(tmp_path / "orders.parquet"))

    def alias(i):
        return F.when(i == 1, " AS first").when(i == 2, " as second").otherwise("")

    key = F.col("o_orderkey")
    text = F.concat(
        F.format_string("# order %d\nARG V=%d\n\n", key, "o_custkey"),
        corpora._repeat((key % 3 + 1).cast("int"), corpora.DOCKER_STAGE, F.col("o_custkey") % 10, alias, lambda i: i, key, lambda i: i),
        F.format_string('cmd   ["%s"]\n', "o_orderpriority"),
    )
    wanted = orders.select(F.format_string("img/%d/Dockerfile", key).alias("path"), text.alias("text"))
    found = corpora.docker_files(spark, str(tmp_path)).select("path", "text")
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


@pytest.mark.parametrize("name", ["from", "RUN", "one", "TWO", "two", "stage2", "stage0", "gone", "", None, "env"])
def test_bodies_of_stages_are_slices(spark, name):
    texts = ["FROM a AS one\nRUN x\nFROM b as two\nENV A=1\nFROM c\nCMD y\n", "ARG z\nFROM a AS two\n", "# none\n", "RUN 1\n", None,
             "FROM a AS two\nRUN 1\nFROM b AS two\nRUN 2\n"]
    rows = spark.createDataFrame([(n, t, name) for n, t in enumerate(texts)], "n int, text string, name string")
    cut = rows.withColumn("instr", dockerfile.instructions(F.col("text")))
    numbered = cut.select(
        "*", dockerfile.with_stage_numbers(F.col("instr")).alias("all"), dockerfile.stages(F.col("instr")).alias("stages"),
        dockerfile.body(F.col("instr"), F.col("name")).alias("body"), dockerfile.stage_names(F.col("instr")).alias("names"))
    for row in numbered.collect():
        kept = [x for x in row["all"] or [] if name is not None and x.inst == name.upper()]
        if not kept:
            number = next((s.stage_no for s in row.stages or [] if s.stage_name == name), None)
            kept = [x for x in row["all"] or [] if number is not None and x.stage_no == number]
        assert row.body == ("\n".join(f"{x.inst} {x.args}" for x in kept) if kept else None)
        assert row.names == (None if row.stages is None else [s.stage_name for s in row.stages])
