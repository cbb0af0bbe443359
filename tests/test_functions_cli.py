import datetime as dt
import math

from pyspark.sql import functions as F

from lakeloom import cli
from lakeloom.functions import compat


def test_gcd_lcm_trunc(spark):
    pairs = [(12, 18), (0, 5), (0, 0), (-4, 6), (2**61 - 1, 3), (433494437, 701408733), (None, 3)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = df.select("a", "b", compat.gcd(F.col("a"), F.col("b")).alias("g"), compat.lcm(F.col("a") % 1000, F.col("b")).alias("l")).collect()
    for a, b, g, lcm in got:
        assert g == (None if a is None else math.gcd(a, b))
        assert lcm == (None if a is None else math.lcm(abs(a) % 1000, b))
    nums = spark.createDataFrame([(1.239,), (-1.239,), (5.0,)], "x double").select(compat.trunc_number(F.col("x"), 2)).collect()
    assert [round(r[0], 9) for r in nums] == [1.23, -1.23, 5.0]


def test_date_bin(spark):
    ts = [dt.datetime(2020, 1, 1, 0, 14, 59, 999999), dt.datetime(1969, 12, 31, 23, 59), dt.datetime(2020, 1, 1, 0, 15)]
    got = spark.createDataFrame([(t,) for t in ts], "t timestamp_ntz").select(compat.date_bin(900, F.col("t")).alias("b")).collect()
    assert [r[0] for r in got] == [dt.datetime(2020, 1, 1), dt.datetime(1969, 12, 31, 23, 45), dt.datetime(2020, 1, 1, 0, 15)]


def test_cli(tmp_path, capsys):
    db = str(tmp_path / "s.db")

    def say(*args):
        assert cli.main(["--services", db, *args]) == 0
        return capsys.readouterr().out.strip()

    assert say("migrate") == "1"
    say("account", "create", "acme")
    say("warehouse", "create", "acme", "w", "--size", "2")
    say("warehouse", "suspend", "acme", "w")
    assert say("warehouse", "list", "acme") == "w 2 suspended"
    say("auth", "user", "acme", "ann")
    say("auth", "role", "acme", "readers")
    say("auth", "assign", "acme", "ann", "readers")
    say("auth", "grant", "acme", "readers", "select", "catalog", "shop")
    assert say("auth", "grants", "acme", "readers") == "SELECT on catalog shop"
    assert say("auth", "key", "acme", "ann").split()[1].startswith("loom_")
    assert say("reap") == "0" and say("history", "acme") == ""
