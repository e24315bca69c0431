from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions.cleaning import clean_batch, clean_replay, number_column, reject_empty, trim_all
from tidemark.functions.messages import parse_messages, to_messages
from tidemark.schema import TRANSACTION_COLUMNS
from tidemark.session import s3a_conf
from tidemark.sources import files
from tidemark.sources.topics import Broker, source_options

TEXT = """# TRANSACTION_ID,TX_DATETIME
0,2019-08-22 06:51:03,4961,3412,81.51,25863,0,0,0
 1 , 2019-08-22 05:10:37 ,2,1365, 146.0 ,18637,0,0,0
2,bad,2,1365,146.0,18637,0,0,0
3,2019-08-22 05:10:37,2,1365,146.0,18637,0,1
4,2019-08-22 05:10:37,2,1365,146.0,18637,0,1,1,EXTRA
5,2019-08-22 05:10:37,,,146.0,18637,0,,

6,2019-08-22 05:10:37,7,8,abc,18637,0,1,1
7,2019-08-22 05:10:37,7,8,1.5,18637.0,0.0,1.0,1
"""


@pytest.fixture()
def text_file(tmp_path):
    path = tmp_path / "tx.txt"
    path.write_text(TEXT)
    return str(path)


def test_text_scan_and_cleaning(spark, text_file):
    assert files.read_text(spark, text_file).count() == 8
    kept = {r.transaction_id: r for r in files.load_transactions(spark, text_file).collect()}
    assert set(kept) == {"0", "1", "3", "4", "7"}
    assert kept["1"].tx_amount == 146.0 and kept["3"].tx_fraud_scenario is None
    # a whole number written with a fraction is still a whole number
    assert kept["7"].tx_time_seconds == 18637 and kept["7"].tx_fraud == 1


def test_replay_scan_types_and_subset(spark, text_file):
    df = files.load_replay(spark, text_file)
    assert dict(df.dtypes)["transaction_id"] == "bigint" and dict(df.dtypes)["tx_datetime"] == "string"
    assert {r.transaction_id for r in df.collect()} == {0, 1, 3, 4, 7}


def test_formats(spark, tmp_path):
    assert files.batch_format("a/b.PARQUET") == "parquet"
    assert files.batch_format("a/b.csv") == "txt"
    assert files.batch_format("a/b.txt", "parquet") == "parquet"
    with pytest.raises(ValueError, match="unsupported"):
        files.batch_format("x", "orc")
    assert [files.replay_format(p) for p in ("x.pq", "x.parquet", "x.CSV", "x.txt")] == ["parquet", "parquet", "csv", "txt"]
    with pytest.raises(ValueError, match="unsupported"):
        files.replay_format("x.json")
    csv = tmp_path / "a.csv"
    csv.write_text("b,a\n01,x\n")
    assert files.load_replay(spark, str(csv)).collect()[0].asDict() == {"b": "01", "a": "x"}


def test_missing_columns_are_named_sorted(spark):
    with pytest.raises(ValueError, match=r"\['tx_amount', 'tx_fraud', 'tx_time_days', 'tx_time_seconds'\]"):
        clean_batch(spark.createDataFrame([("x",)], "tx_datetime string"))


def test_nothing_left_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.txt"
    path.write_text("0,bad,1,1,1,1,1,1,1\n")
    with pytest.raises(ValueError, match="empty"):
        files.load_transactions(spark, str(path))
    with pytest.raises(ValueError, match="empty"):
        reject_empty(spark.range(0), "x")


def test_whole_number_text(spark):
    """The rule of lenient casts: cut the fraction, refuse everything else."""
    want = {
        "1.9": 1, "-1.9": -1, ".5": 0, "1.": 1, "1.a": None, "+5": 5, "1e3": None, "-.5": 0,
        "-": None, "9223372036854775808": None, "1.9.9": None, "": None, "0x10": None, "1 ": 1,
    }
    df = spark.createDataFrame([(v,) for v in want], "tx_time_seconds string")
    got = df.select("*", number_column(df, "tx_time_seconds").alias("n")).collect()
    assert {r.tx_time_seconds: r.n for r in got} == want


@pytest.mark.parametrize(
    "text",
    ["2019-8-2 1:2:3", "2019-02-30 00:00:00", "2019-08-22T06:51:03", "2019-08-22 24:00:00", "2019-08-22 06:51:03 "],
)
def test_strict_timestamps(spark, text):
    from tidemark.functions.calendar import parse_datetime

    assert spark.createDataFrame([(text,)], "t string").select(parse_datetime(F.col("t"))).first()[0] is None


def test_nan_amount_survives_batch_and_becomes_zero(spark):
    from tidemark.functions.calendar import add_features

    row = [("1", "2019-08-24 05:10:37", "1", "1", "NaN", "1", "1", "0", "0")]
    df = spark.createDataFrame(row, list(TRANSACTION_COLUMNS))
    features = add_features(clean_batch(df)).first()
    assert features.tx_amount == 0.0 and features.tx_day_of_week == 7 and features.is_weekend == 1
    assert clean_replay(df).count() == 0


def test_parquet_input_is_not_trimmed(spark, tmp_path):
    row = [("1", " 2019-08-24 05:10:37", "1", "1", "1", "1", "1", "0", "0")]
    df = spark.createDataFrame(row, list(TRANSACTION_COLUMNS))
    assert clean_batch(df).count() == 0 and clean_batch(trim_all(df)).count() == 1


PAYLOADS = [
    ('{"transaction_id":1,"tx_datetime":"2019-08-22 06:51:03","tx_amount":2.5,"tx_time_days":1}', 1),
    ("garbage", None),
    ('{"transaction_id":"7","tx_amount":1.0}', None),
    ('{"transaction_id":8,"tx_amount":"abc","tx_time_days":3}', 8),
    ('{"tx_amount":"abc","transaction_id":9}', 9),
    ('{"transaction_id":10.5}', None),
    ("{}", None),
    ("null", None),
    ('[{"transaction_id":11}]', None),
    ('{"transaction_id":12} trailing', 12),
    ('{"TRANSACTION_ID":13}', None),
    ("", None),
    (None, None),
]


def test_payload_reading(spark):
    rows = [(str(i), p) for i, (p, _) in enumerate(PAYLOADS)]
    raw = spark.createDataFrame(rows, "key string, value string").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    got = {int(r.message_key): r for r in parse_messages(raw).collect()}
    assert [got[i].transaction_id for i in range(len(PAYLOADS))] == [want for _, want in PAYLOADS]
    assert got[3].tx_amount is None and got[3].tx_time_days == 3


def test_message_key_must_exist(spark):
    with pytest.raises(ValueError, match="key column"):
        to_messages(spark.range(1))


def test_null_fields_are_left_out(spark):
    df = spark.sql("SELECT 1L AS transaction_id, CAST(NULL AS DOUBLE) AS tx_amount")
    assert to_messages(df).first().value == '{"transaction_id":1}'


def test_s3_settings_need_all_keys():
    keys = {"endpoint_url": "e", "access_key": "a"}
    assert s3a_conf(None) == {} and s3a_conf(keys) == {}
    conf = s3a_conf({**keys, "secret_key": "s"})
    assert conf["spark.hadoop.fs.s3a.endpoint"] == "e" and conf["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert len(conf) == 6


def test_scratch_folder(spark, monkeypatch):
    from tidemark import session

    class Conf:
        def __init__(self, root):
            self.root = root

        def get(self, key, default=None):
            return self.root if key == "spark.checkpoint.dir" else default

    class Context:
        def __init__(self, master):
            self.master, self.applicationId = master, "app-1"

    class Session:
        def __init__(self, root, master):
            self.conf, self.sparkContext = Conf(root), Context(master)

    assert session.scratch_root(Session("hdfs://shared/dir/", "yarn")) == "hdfs://shared/dir"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Session(None, "yarn"))
    local = Session(None, "local[2]")
    assert session.scratch_root(local) == session.scratch_root(local)


def test_broker_options():
    broker = Broker("h:9091", "u", "p")
    options = source_options(broker, "t")
    assert options["subscribe"] == "t" and options["startingOffsets"] == "earliest" and options["failOnDataLoss"] == "false"
    assert options["kafka.sasl.mechanism"] == "SCRAM-SHA-512" and options["kafka.security.protocol"] == "SASL_SSL"
    assert 'username="u" password="p";' in options["kafka.sasl.jaas.config"]
    assert "maxOffsetsPerTrigger" in source_options(broker, "t", 10) and "p" not in repr(broker).split("username")[1].split("'")[2:]
