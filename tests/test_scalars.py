import pytest
from pyspark.sql import functions as F

from fieldlab.functions import scalars as S


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("name,want", [
    ("foo.wav", "foo.wav"), ("Amaziliadecora1061880-volume-10.wav", "Amaziliadecora1061880.wav"),
    ("Amaziliadecora1061883-rain_bgd0ms.wav", "Amaziliadecora1061883.wav"), ("foo/bar/Am1-shift4600ms.wav", "foo/bar/Am1.wav"), ("/foo/bar/Am1-shift4600ms.wav", "/foo/bar/Am1.wav"),
])
def test_original_file_name(spark, name, want):
    assert one(spark, S.original_file_name("p"), p=name) == want


def test_recording_id(spark):
    assert one(spark, S.recording_id("p"), p="/foo/bar/AM01_20190719_063242.png") == "AM01_20190719_063242"
    assert one(spark, S.recording_id("p"), p="/foo/AM01_20190719_063242/bar.png") is None


def test_natural_order(spark):
    df = spark.createDataFrame([("Foo30",), ("Foo4b",), ("Foo3",)], "s string")
    assert [r.s for r in df.orderBy(S.natural_key("s")).collect()] == ["Foo3", "Foo4b", "Foo30"]
    long = [f"a{'9' * 20}{i}b" for i in range(3)] + ["a" + "1" + "0" * 21 + "b"]
    df = spark.createDataFrame([(x,) for x in reversed(long)], "s string")
    assert [r.s for r in df.orderBy(S.natural_key("s")).collect()] == long


def test_image_suffixes(spark):
    assert one(spark, S.is_image_file("p"), p="/a/b.png") and not one(spark, S.is_image_file("p"), p="/a/b.PNG")


@pytest.mark.parametrize("path,want", [
    ("/data/anna/project/recordings/2019/CALL_XC12345-R02 some small bird.mp3", "/data/...CALL_XC12345-R02 some small bird.mp3"),
    ("data/anna/project/CALL_XC12345-R02 some small bird.mp3", "data/...CALL_XC12345-R02 some small bird.mp3"),
    ("foobar", "foobar"), ("foobar/fum", "foobar/fum"), ("a_long_folder/another_folder/b/c/file.txt", "a_long_folder/.../c/file.txt"),
])
def test_ellipsed_path(spark, path, want):
    assert one(spark, S.ellipsed_path("p"), p=path) == want


def test_run_names(spark):
    props = {"net": F.lit("resnet18"), "bs": F.lit(2), "folds": F.lit(3), "seed": F.lit(42), "ks": F.lit(7), "lr": F.lit(0.01), "gray": F.lit(False)}
    name = one(spark, S.run_filename("model", props, ".pth"), p="")
    assert name == "model_net_resnet18_bs_2_folds_3_ks_7_lr_0.01_gray_False.pth"
    got = one(spark, S.parse_run_filename("p"), p="run_2021-03-11T10_59_02_net_resnet18_pre_True_lr_0.01_opt_SGD_bs_64_ks_7_folds_0_classes_10.csv")
    assert (got.net, got.pre, got.lr, got.opt, got.bs, got.ks, got.folds, got.classes, got.gray) == ("resnet18", True, 0.01, "SGD", 64, 7, 0, 10, None)
    assert one(spark, S.run_timestamp("p"), p="run_2021-03-11T10_59_02_net.csv") == "2021-03-11T10_59_02"


def test_small_texts(spark):
    assert one(spark, S.duration_text("p", 5), p=694861) == "1.0 week, 1.0 day, 1.0 hour, 1.0 minute, 1.0 second"
    assert one(spark, S.duration_text("p"), p=10) == "10.0 seconds"
    assert one(spark, S.duration_text("p"), p=0.5) == "< 1sec>"
    assert one(spark, S.bytes_text("p"), p=1536) == "1.5KB"
    assert one(spark, S.bytes_text("p"), p=10) == "10.0B"
    assert one(spark, S.minutes_seconds("p"), p="1:05") == 65.0
    assert one(spark, S.split_list("p"), p=" a, b ,") == ["a", "b"]
    assert one(spark, S.split_list("p"), p="[a, b]") is None
    assert [one(spark, S.str2bool("p"), p=x) for x in ("yes", "True", "no", "true")] == [True, True, False, False]
    assert one(spark, S.serial_number("p"), p="/x/AM01_2019_050001.wav") == 50001
    assert one(spark, S.serial_number("p"), p="/x/foo.wav") is None
    assert tuple(one(spark, S.log_name_parts("p"), p="run_K7_B64.jsonl")) == (7, 64)
    assert one(spark, S.file_timestamp(F.lit("2021-03-11 10:59:02").cast("timestamp")), p="") == "2021-03-11T10_59_02"


def test_vocalizations(spark):
    kinds = ["alarm call, song", "Song", "x", None]
    got = [one(spark, S.vocalization_type(F.lit(k).cast("string")), p="") for k in kinds]
    assert got == ["CALL", "SONG", "UNKNOWN", "UNKNOWN"]
    name = lambda n, k: one(spark, S.ensure_vocalization_prefix("n", "k"), n=n, k=k)
    assert [name("a.mp3", "call"), name("CALL_a.mp3", "song"), name("UNKNOWN_a.mp3", "song"), name("UNKNOWN_a.mp3", "x")] == ["CALL_a.mp3", "CALL_a.mp3", "SONG_a.mp3", "UNKNOWN_a.mp3"]


def test_arrays_and_maps(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], {"a": "1", "b": "2"}, {"b": "3"})], "a array<double>, m map<string,string>, n map<string,string>")
    row = df.select(S.argmax("a").alias("i"), S.softmax("a").alias("s"), S.minmax_scale("a", 0, 255).alias("z"), S.one_hot(F.lit(1), 3).alias("o"), S.map_update("m", "n").alias("u"), S.minmax_scale(F.array(F.lit(1.0), F.lit(1.0)), 0, 1).alias("c")).first()
    assert row.i == 1 and abs(sum(row.s) - 1) < 1e-12 and row.z == [0, 255, 255] and row.o == [0, 1, 0] and row.u == {"a": "1", "b": "3"} and row.c is None
