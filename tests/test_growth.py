"""What made the time of whole jobs grow faster than their tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from causeway.operators.moments import as_double
from causeway.plans import queries

SF = "/root/testdata/sf0.001"
JIT_LIMIT = 8000  # bytes of a method; the virtual machine interprets longer ones


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["diag_dwh", "diag_all", "diag_sargan", "diag_reset"])
def test_aggregates_over_derived_columns_are_compiled(spark, monkeypatch, capsys, name):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows its code only once it has run
    frame = type(spark.range(1))
    first = frame.first

    def shown(self):
        self.explain("codegen")
        return first(self)

    monkeypatch.setattr(frame, "first", shown)
    capsys.readouterr()
    try:
        queries.QUERIES[name](spark, SF)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(s) for s in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert len(sizes) >= 4 and max(sizes) < JIT_LIMIT


def test_nan_is_null_in_every_type(spark):
    df = spark.sql("SELECT * FROM VALUES (cast('NaN' AS double), cast('NaN' AS float), 1, true), (NULL, NULL, NULL, NULL), (-0.5e0, cast(2 AS float), 3, false) AS q(d, f, i, b)")
    assert [tuple(r) for r in df.select(*[F.round(as_double(c), 3) for c in df.columns]).collect()] == [(None, None, 1.0, 1.0), (None,) * 4, (-0.5, 2.0, 3.0, 0.0)]
