"""Where ``live_stats`` keeps the records that its join waits with."""

import glob
import json

from pyspark.sql import functions as F

from logspark.operators.enrich import enrich
from logspark.sources.adapters import raw_logs, read_table
from logspark.streaming import stream as ST
from tests.conftest import SF_SMALL


def test_join_state_lies_on_disk(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in ST.ON_DISK}
    ev = read_table(spark, SF_SMALL, "events")
    ev.write.parquet(f"{tmp_path}/events")
    ev.filter("event_id % 3 = 0").select(F.col("event_id").alias("id"), F.col("ts").alias("deleted_at")).write.parquet(f"{tmp_path}/deletes")
    ST.live_stats(enrich(raw_logs(ST.events_stream(spark, f"{tmp_path}/events", glob="*.parquet"))),
                  spark.readStream.schema("id long, deleted_at timestamp_ntz").parquet(f"{tmp_path}/deletes"),
                  f"{tmp_path}/run", "40 days", "90 days")
    with open(min(glob.glob(f"{tmp_path}/run/checkpoint/offsets/[0-9]*"))) as f:
        conf = json.loads(f.read().split("\n")[1])["conf"]
    assert conf["spark.sql.streaming.stateStore.providerClass"] == ST.ROCKSDB
    assert conf["spark.sql.streaming.join.stateFormatVersion"] == "3"
    assert not glob.glob(f"{tmp_path}/run/checkpoint/state/**/*.delta", recursive=True)
    assert glob.glob(f"{tmp_path}/run/checkpoint/state/**/*.zip", recursive=True)
    assert {k: spark.conf.get(k, None) for k in ST.ON_DISK} == before      # other queries keep theirs
