import os

from tessera.sources.csv import dedupe_names, read_csv
from tessera.functions.columns import NA_STRINGS


def _write(tmp_path, name, text):
    p = os.path.join(tmp_path, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_csv_type_inference(spark, tmp_path):
    p = _write(tmp_path, "types.csv",
               "i,f,b,bn,d,m,e,z\n1,1.5,True,True,2020-01-01,NA,,007\n2,NA,False,,2020-01-02,3,,008\n")
    df = read_csv(spark, p)
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "bn": "boolean", "d": "string",
                               "m": "bigint", "e": "double", "z": "bigint"}
    rows = sorted(df.collect(), key=lambda r: r["i"])
    assert rows[0]["f"] == 1.5 and rows[1]["f"] is None
    assert rows[0]["bn"] is True and rows[1]["bn"] is None
    assert rows[0]["z"] == 7 and rows[1]["z"] == 8
    assert rows[0]["e"] is None and rows[1]["m"] == 3


def test_csv_na_strings_are_null(spark, tmp_path):
    body = "\n".join(f'"{s}"' if s == "" else s for s in NA_STRINGS[1:])
    p = _write(tmp_path, "na.csv", "x,y\n" + "\n".join(f"{s},1" for s in NA_STRINGS[1:]) + "\n,1\n")
    df = read_csv(spark, p)
    assert dict(df.dtypes)["x"] == "double"
    assert df.where("x is not null").count() == 0
    assert df.count() == len(NA_STRINGS)
    del body


def test_csv_duplicate_headers(spark, tmp_path):
    p = _write(tmp_path, "dup.csv", "a,a,,b\n1,2,3,x\n")
    assert read_csv(spark, p).columns == ["a", "a.1", "Unnamed: 2", "b"]
    assert dedupe_names(["a", "a", "a.1", "a"]) == ["a", "a.1", "a.1.1", "a.2"]


def test_csv_quoted_fields_and_floats(spark, tmp_path):
    p = _write(tmp_path, "q.csv", 'name,v\n"x, ""y""",1e3\nz,.5\nw,-inf\n')
    df = read_csv(spark, p)
    assert dict(df.dtypes) == {"name": "string", "v": "double"}
    vals = {r["name"]: r["v"] for r in df.collect()}
    assert vals['x, "y"'] == 1000.0 and vals["z"] == 0.5 and vals["w"] == float("-inf")


def test_csv_rejects_java_suffixes(spark, tmp_path):
    p = _write(tmp_path, "s.csv", "v\n1d\n2\n")
    assert dict(read_csv(spark, p).dtypes)["v"] == "string"
