"""Tables in the shared folder: few files, each checked as it is read."""

import os
from urllib.parse import urlparse

import numpy as np
import pytest

from pyspark.sql import functions as F

from eavspark.llm.shared import running_total, stage


@pytest.fixture
def dealt(spark):
    """64 shuffle partitions, all of them kept."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def folder(df):
    return os.path.dirname(urlparse(df.inputFiles()[0]).path)


def test_no_file_of_checksums(spark):
    """Each is one more process that an executor starts."""
    df = spark.range(0, 1000, 1, 4).withColumn("x", F.col("id") * 3)
    out = stage(df)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    assert not [x for x in os.listdir(folder(out)) if x.endswith(".crc")] and len(out.inputFiles()) == 4


def test_damage_is_seen(spark):
    out = stage(spark.range(0, 20_000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("x")))
    at = urlparse(out.inputFiles()[0]).path
    with open(at, "r+b") as f:
        f.seek(os.path.getsize(at) // 2)
        byte = f.read(1)
        f.seek(-1, os.SEEK_CUR)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        out.agg(F.sum(F.length("x"))).collect()


def test_narrow_tables_have_few_files(dealt):
    rows = dealt.range(0, 5000, 1, 8).select(F.col("id").alias("k"), (F.col("id") * 7 % 13).alias("v"))
    got = running_total(rows, ["k"], "v")
    assert 2 <= len(got.inputFiles()) <= 16
    v = np.arange(5000) * 7 % 13
    assert dict((r.k, r.before) for r in got.collect()) == dict(enumerate(np.cumsum(np.append(0, v[:-1])).tolist()))
