"""The .tsf data source: ranges, types, folders, malformed files, and a round trip."""

from datetime import datetime

import pytest

from lacuna.errors import LacunaError
from lacuna.sources import tsf

HEAD = "# note\n@relation r\n@attribute series_name string\n@attribute start_timestamp date\n@attribute level numeric\n@missing true\n@data\n"


@pytest.mark.parametrize("split", [1, 7, 40, 1 << 20])
def test_ranges_lose_and_repeat_nothing(spark, tmp_path, split):
    rows = [(f"T{i}é", datetime(2020, 1, 1 + i, 5, 30, 7), None if i == 3 else i / 2, [float(i), None, -1.5][: i % 4]) for i in range(12)]
    lines = [f"{n}:{t:%Y-%m-%d %H-%M-%S}:{'?' if v is None else v}:{','.join('?' if x is None else str(x) for x in xs)}" for n, t, v, xs in rows]
    (tmp_path / "a.tsf").write_bytes((HEAD + "\n".join(lines[:7]) + "\n\n# end\n").encode("iso-8859-1"))
    (tmp_path / "b.tsf").write_bytes((HEAD + "\r\n".join(lines[7:])).encode("iso-8859-1"))
    (tmp_path / "_hidden").write_text("no header")
    tsf.register(spark)
    df = spark.read.format("tsf").option("split_bytes", split).load(str(tmp_path))
    assert [t for _, t in df.dtypes] == ["string", "timestamp_ntz", "double", "array<double>"]
    assert sorted(tuple(r) for r in df.collect()) == sorted(rows)


@pytest.mark.parametrize("text", ["@attribute a string\nT1:1,2\n", "@attribute a oops\n@data\nx:1\n", "@data\n1,2\n"])
def test_malformed_headers_raise(spark, tmp_path, text):
    (tmp_path / "x.tsf").write_text(text)
    tsf.register(spark)
    with pytest.raises(Exception, match="data section|bad attribute|no attribute"):
        spark.read.format("tsf").load(str(tmp_path / "x.tsf")).collect()


def test_malformed_lines_raise(spark, tmp_path):
    (tmp_path / "x.tsf").write_text("@attribute a string\n@data\none:two:1,2\n")
    tsf.register(spark)
    with pytest.raises(Exception, match="3 fields in place of 2"):
        spark.read.format("tsf").load(str(tmp_path / "x.tsf")).collect()
    with pytest.raises(LacunaError):
        tsf._files(str(tmp_path / "none"))


def test_round_trip(spark, tmp_path):
    rows = [("a", 1.5, [1.0, None, 3.25]), (None, None, [-2.0]), ("b c", 2.0, [1e-9, 1e12])]
    df = spark.createDataFrame(rows, "name string, level double, series_value array<double>").repartition(3)
    tsf.write_tsf(df, str(tmp_path / "out"))
    tsf.register(spark)
    assert sorted(map(str, map(tuple, spark.read.format("tsf").load(str(tmp_path / "out")).collect()))) == sorted(map(str, rows))
    with pytest.raises(Exception, match="colon"):
        tsf.write_tsf(spark.createDataFrame([("a:b", [1.0])], "name string, series_value array<double>"), str(tmp_path / "bad"))
