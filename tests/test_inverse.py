"""The rounds of the blocked inverse leave as many partitions, and as small a plan, as they found."""

import numpy as np
from pyspark.sql import functions as F

from cinelake.operators import ease


def test_rounds_keep_partitions_and_plan_size(spark):
    n, block = 23, 3
    m = -(-n // block)
    x = np.random.default_rng(7).random((60, n))
    g = x.T @ x
    entries = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(n) for j in range(n)], "i long, j long, g double")
    blocks = ease.to_blocks(entries, n, 0.5, block).repartition(3, "bi", "bj")
    out = ease.invert_blocks(blocks, m, block)
    assert out.rdd.getNumPartitions() <= 2 * max(3, spark.sparkContext.defaultParallelism)
    assert len(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 20
    got = np.zeros((n, n))
    for r in ease.from_blocks(out, block).where(F.col("p").isNotNull()).collect():
        got[r["i"], r["j"]] = r["p"]
    np.testing.assert_allclose(got, np.linalg.inv(g + 0.5 * np.eye(n)), atol=1e-9)
