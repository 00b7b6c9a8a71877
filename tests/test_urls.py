import pytest

from lakeferry.plans.options import Settings, codec_of, copy_options
from lakeferry.sources.urls import expand_ranges, list_files, locate, scheme_of


@pytest.mark.parametrize(
    "url, address, path",
    [
        ("file:///tmp/x.csv", "/tmp/x.csv", "file:///tmp/x.csv"),
        ("s3://b.s3.us-east-2.amazonaws.com/d/x.csv", "https://b.s3.us-east-2.amazonaws.com/d/x.csv", "s3a://b/d/x.csv"),
        ("s3://b/d/x.csv", "s3://b/d/x.csv", "s3a://b/d/x.csv"),
        ("gs://b/x.csv", "https://storage.googleapis.com/b/x.csv", "s3a://b/x.csv"),
        ("gcs://storage.googleapis.com/b/x.csv", "https://storage.googleapis.com/b/x.csv", "s3a://b/x.csv"),
        ("az://acc.blob.core.windows.net/cont/d/x.csv", "https://acc.blob.core.windows.net", "wasbs://cont@acc.blob.core.windows.net/d/x.csv"),
        ("az://acc.blob.core.windows.net/cont/x.csv?sv=1", "https://acc.blob.core.windows.net?sv=1", "wasbs://cont@acc.blob.core.windows.net/x.csv"),
        ("abfss://cont@acc/x.csv", "https://acc.blob.core.windows.net", "wasbs://cont@acc.blob.core.windows.net/x.csv"),
        ("hdfs://n:9000/x.csv", "hdfs://n:9000/x.csv", "hdfs://n:9000/x.csv"),
    ],
)
def test_addresses(url, address, path):
    got = locate(url)
    assert (got.address, got.path) == (address, path)


@pytest.mark.parametrize(
    "url, text",
    [("file://x.csv", "relative path"), ("abfs://acc/x", "missing the container part"), ("az://acc/c/x", "storage account host"), ("az://acc.blob.core.windows.net/", "container name"), ("ftp://x", "cannot read URL")],
)
def test_bad_addresses(url, text):
    with pytest.raises(ValueError, match=text):
        locate(url)


def test_credentials():
    of = "fs.s3a.bucket.b."
    plain = locate("s3://b/x").conf
    assert "Anonymous" in plain[of + "aws.credentials.provider"]
    conf = locate("s3://b/x", copy_options(access_key="k", session_token="t")).conf
    assert (conf[of + "access.key"], conf[of + "secret.key"], conf[of + "session.token"]) == ("k", "", "t")
    assert plain[of + "access.key"] is plain[of + "session.token"] is None  # so that a later call doesn't sign with them
    conf = locate("gs://b/x", copy_options(access_key="k", session_token="t")).conf
    assert conf[of + "session.token"] is None and conf[of + "endpoint"] == "https://storage.googleapis.com" and conf[of + "access.key"] == "k"
    assert locate("https://h/x", copy_options(timeout=1500)).conf["seconds"] == "2"
    assert scheme_of("S3://b") is None and scheme_of("plain") is None


def test_options():
    for bad in ({"freeze": 1}, {"timeout": -1}, {"timeout": 1 << 32}, {"encoding_check": "x"}, {"compression": "rar"}):
        with pytest.raises(ValueError):
            copy_options(**bad)
    assert copy_options(encoding_check="REMOVE", structure="a Int8,\nb Int8").structure == "a Int8, b Int8"
    assert "hush" not in repr(copy_options(access_key="a", access_secret="hush").redacted())
    assert (codec_of("x.csv.gz", "auto"), codec_of("x.csv", "auto"), codec_of("x", "zstd")) == ("gzip", "none", "zstd")
    with pytest.raises(ValueError, match="-1 MB is outside the valid range"):
        Settings(max_memory=-1)


def test_ranges():
    assert expand_ranges("a_{1..3}.{x,y}") == "a_{1,2,3}.{x,y}"
    assert expand_ranges("{08..11}") == "{08,09,10,11}"
    with pytest.raises(ValueError):
        expand_ranges("{3..1}")


@pytest.mark.parametrize("pattern, names", [("a/*.csv", "a1 a2"), ("a/?1.csv", "a1"), ("{a/a1,b/c/c1}.csv", "a1 c1"), ("a/a{1..2}.csv", "a1 a2"), ("**.csv", "a1 a2 c1"), ("a", "a1 a2")])
def test_patterns(spark, tmp_path, pattern, names):
    for name in ("a/a1", "a/a2", "b/c/c1"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"{name}.csv").write_text("1\n")
    got = list_files(spark, locate(f"file://{tmp_path}/{pattern}"))
    assert " ".join(p.rsplit("/", 1)[1][:-4] for p in got) == names
