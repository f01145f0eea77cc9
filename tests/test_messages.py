"""Few numbers go through a plain loop, many through arrays; the bytes are the same."""

import time

import numpy as np
import pandas as pd
import pytest
from ridgeline.functions import messages
from ridgeline.sources import pbf

HARD = [0, 1, 127, 128, 300, 2**21, 2**63 - 1, 2**63, 2**64 - 1]
SIGNED = [0, -1, 5, -(2**63), 2**63 - 1, 3, 3, -7]


def test_few_numbers_are_packed_as_many_are(monkeypatch):
    few = [messages.packed(HARD), messages.steps(SIGNED), messages.unpacked(messages.packed(HARD)).tolist(), messages.sums(messages.steps(SIGNED)).tolist()]
    monkeypatch.setattr(messages, "FEW", -1)
    assert few == [messages.packed(HARD), messages.steps(SIGNED), HARD, SIGNED]
    assert messages.unpacked(messages.packed(HARD)).tolist() == HARD and messages.sums(messages.steps(SIGNED)).tolist() == SIGNED
    monkeypatch.undo()
    for wrong in (-1, 2**64):
        with pytest.raises(OverflowError):
            messages.packed([wrong])


def test_a_block_of_ways_in_little_time():
    """8,000 ways took some 6 seconds when each number went through arrays."""
    n = 8000
    ways = pd.DataFrame({"kind": "way", "id": range(n), "tags": [{"highway": "primary", "name": f"n{i}"} for i in range(n)], "lon": None, "lat": None, "refs": [np.arange(4) + i * 64 for i in range(n)]})
    begun = time.process_time()
    found = list(pbf.elements_of(pbf.block_of(ways)))
    assert time.process_time() - begun < 3
    assert [x[1] for x in found] == list(range(n)) and found[-1][5] == [(n - 1) * 64 + k for k in range(4)] and found[9][2] == {"highway": "primary", "name": "n9"}


def test_blocks_are_decoded_by_many_tasks(spark, tmp_path):
    """The places of blocks are a few bytes; they are dealt out all the same."""
    from pyspark.sql import functions as F

    e = spark.range(40_000).select(F.lit("node").alias("kind"), "id", F.lit(None).cast("map<string,string>").alias("tags"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), F.lit(None).cast("array<bigint>").alias("refs"))
    assert pbf.write(e.coalesce(1), str(tmp_path / "m")) == 40_000
    raw = pbf.read_raw(pbf.listed(spark, str(tmp_path / "m")))
    assert raw.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and raw.select("id").distinct().count() == 40_000
