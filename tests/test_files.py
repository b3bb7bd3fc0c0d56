import datetime as dt
import gzip
import json
import struct
from pathlib import Path

import pytest

from cambium.operators import structure, validate
from cambium.plans import archive
from cambium.sources import documents, measurements
from cambium.streaming import arrivals
from pyspark.sql import types as T


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def cells_file(path, years, columns=measurements.CELL_COLUMNS):
    write(path, ["\t".join(["ID", *columns, "CID"]), *("\t".join(["x", str(y), *["1.5"] * (len(columns) - 1), "9"]) for y in years)])


def rings_file(path, years):
    write(path, ["\t".join(measurements.RING_COLUMNS), *("\t".join([str(y), *["2.5"] * 8]) for y in years)])


def settings_file(path):
    rows = [(17, "1"), (8, "conf"), (13, "12.5 / 3"), (12, "2.27"), (9, "03.02.2021 10:11:12"), (31, "12.7"), (20, "2010"), (999, "other")]
    write(path, ["RNUM\tSETTING\tDESCRIPTION", *(f"{n}\t{v}\td" for n, v in rows)])


def jpeg(path, width, height):
    frame = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, height, width) + b"\0" * 20
    path.write_bytes(frame)


@pytest.fixture
def folder(tmp_path):
    for stem, years in (("SITEA_PISY_01A_1_1", [2000, 2001]), ("SITEA_PISY_01A_1_2", [2001])):
        cells_file(tmp_path / "in" / f"{stem}_Output_Cells.txt", years)
        rings_file(tmp_path / "in" / f"{stem}_Output_Rings.txt", years)
        settings_file(tmp_path / "in" / f"{stem}_ROXAS_Settings.txt")
        jpeg(tmp_path / "in" / f"{stem}.jpg", 640, 480)
        jpeg(tmp_path / "in" / f"{stem}_annotated.jpg", 1, 1)
    return tmp_path / "in"


def sets_with_labels(spark, folder):
    sets = measurements.file_sets(measurements.found_files(spark, str(folder)))
    return structure.structure_from_names(sets.withColumnRenamed("stem", "name"))


def test_discovery_and_structure(spark, folder):
    files = measurements.found_files(spark, str(folder))
    assert files.count() == 8 and measurements.incomplete_sets(files).isEmpty()
    got = sorted(r["image_label"] for r in sets_with_labels(spark, folder).collect())
    assert got == ["SITEA_PISY_01A_1_1".replace("01A", "01_A"), "SITEA_PISY_01_A_1_2"]
    measurements.assert_complete(files)
    with pytest.raises(measurements.IncompleteError, match="no measurement files"):
        measurements.assert_complete(files.limit(0))
    (folder / "SITEA_PISY_01A_1_2_Output_Rings.txt").unlink()
    with pytest.raises(measurements.IncompleteError, match="SITEA_PISY_01A_1_2 has no rings"):
        measurements.assert_complete(measurements.found_files(spark, str(folder)))
    assert [tuple(r) for r in measurements.incomplete_sets(measurements.found_files(spark, str(folder))).collect()] == [("SITEA_PISY_01A_1_2", "rings")]


def test_measurements(spark, folder):
    old = ["BEND" if c == "TB2" else "CA" if c == "LA" else c for c in measurements.CELL_COLUMNS]
    cells_file(folder / "SITEA_PISY_01A_1_2_Output_Cells.txt", [2001, "NA"], old)
    data = sets_with_labels(spark, folder)
    cells, bad = measurements.collect_cells(spark, data)
    assert cells.count() == 3 and [r[0] for r in bad.collect()] == ["SITEA_PISY_01_A_1_2"]
    assert {r["la"] for r in cells.collect()} == {1.5} and cells.schema["year"].dataType == T.IntegerType()
    rings, none = measurements.collect_rings(spark, data)
    assert none.isEmpty() and rings.filter("dh_w = 2.5 AND dh_m = 2.5").count() == 3
    cells_file(folder / "SITEA_PISY_01A_1_2_Output_Cells.txt", [2001], measurements.CELL_COLUMNS[:-1])
    assert [r[0] for r in measurements.collect_cells(spark, data)[1].collect()] == ["SITEA_PISY_01_A_1_2"]


def test_settings_and_images(spark, folder):
    data = sets_with_labels(spark, folder)
    got = measurements.collect_settings(spark, [r["fname_settings"] for r in data.collect()]).collect()
    assert len(got) == 2
    r = got[0]
    assert (r["meas_geometry"], r["origin_calibrated_x"], r["origin_calibrated_y"], r["min_cell_area"], r["spatial_resolution"], r["configuration_file"]) == ("linear", 12.5, 3.0, 12, 2.27, "conf")
    info = measurements.collect_image_info(spark, [r["fname_image"] for r in data.collect()]).collect()
    assert {(r["img_width"], r["img_height"]) for r in info} == {(640, 480)}
    with pytest.raises(NotImplementedError):
        measurements.collect_settings(spark, [], "other")
    dates = structure.parsed_dates(spark.createDataFrame([("03.02.2021 10:11:12",), ("3/2/2021 9:05",), ("01.01.2099 00:00:00",), ("x",)], "d string"), "d", dt.datetime(2025, 1, 1)).collect()
    assert [r["date_problem"] for r in dates] == [None, None, "future", "unparsed"] and dates[1]["d"] == dt.datetime(2021, 2, 3, 9, 5)


def long_jpeg(width, height, segments=40):
    """A JPEG whose frame header comes after megabytes of other segments, with fill bytes before markers."""
    segment = b"\xff\xff\xff\xe1" + struct.pack(">H", 65535) + b"\xff\xc0" + b"t" * 65531  # a thumbnail's frame header doesn't count
    return b"\xff\xd8" + segment * segments + b"\xff" * 200 + b"\xc2" + struct.pack(">HBHH", 17, 8, height, width) + b"\0" * 50_000


def test_image_heads_are_read_in_ranges():
    data, asked = long_jpeg(4321, 1234), []

    def read(at, n):
        asked.append(n)
        return data[at : at + n]

    assert measurements.frame_size(read) == (4321, 1234) and sum(asked) < 4000 < 1 << 20 < len(data)
    for odd in (b"", b"\xff\xd8", b"PNG", b"\xff\xd8\xff\xe0\x00\x00", b"\xff\xd8\xff\xda\x00\x08", b"\xff\xd8" + b"\xff" * 500, b"\xff\xd8\xff\xc0\x00\x11"):
        assert measurements.frame_size(lambda at, n, o=odd: o[at : at + n]) == (None, None)


def test_image_info_of_odd_files(spark, tmp_path, monkeypatch):
    (tmp_path / "a b.jpg").write_bytes(long_jpeg(70, 80, 20))
    (tmp_path / "no.JPEG").write_bytes(b"text")
    (tmp_path / "x.png").write_bytes(b"text")
    data = spark.createDataFrame([(f"{p}",) for p in (f"file:{tmp_path}/a b.jpg", tmp_path / "no.JPEG", tmp_path / "gone.jpg", tmp_path / "x.png", tmp_path / "no.JPEG")] + [(None,)], "fname_image string")
    show = lambda df: {r[0].rsplit("/", 1)[1]: tuple(r)[1:] for r in df.collect()}
    size = (tmp_path / "a b.jpg").stat().st_size
    assert show(measurements.collect_image_info(spark, data)) == {"a b.jpg": ("JPEG", size, 70, 80), "no.JPEG": (None, 4, None, None), "gone.jpg": (None, None, None, None)}
    monkeypatch.setattr(measurements, "known_to_python", lambda path: False)  # by Spark's own reader
    assert show(measurements.collect_image_info(spark, data)) == {"a b.jpg": ("JPEG", size, 70, 80), "no.JPEG": (None, 4, None, None)}


def test_settings_of_named_files_only(spark, folder):
    data = sets_with_labels(spark, folder)
    got = measurements.collect_settings(spark, data.filter("name LIKE '%_2'")).collect()
    assert [r["fname_settings"] for r in got] == [r["fname_settings"] for r in data.collect() if r["name"].endswith("_2")]
    assert measurements.collect_settings(spark, data.filter("false")).isEmpty()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_records_are_split_wherever_chunks_end(size):
    doc = {"$schema": "x[{", "a": [{"t": 'q"\\{["', "n": [1, {"m": "}"}]}, {}, {"t": "é漢\\\\"}], "none": [], "o": {"k": [{"x": 1}]}, 'b " [': [{"z": None}]}
    text = json.dumps(doc, ensure_ascii=False, indent=1)
    got = list(documents.split_records(iter([text[i : i + size] for i in range(0, len(text), size)])))
    named = [(t, None if r is None else json.loads(r)) for t, r in got]
    assert named == [x for k, v in doc.items() if isinstance(v, list) for x in [(k, None), *((k, r) for r in v)]]


def test_a_document_is_written_in_parts(spark, tmp_path, monkeypatch):
    images = spark.range(5000).selectExpr("concat('i', id) AS image_label", r"""CASE WHEN id % 3 = 0 THEN 'say "[{\n' END AS note""").repartition(7)
    none = spark.createDataFrame([], "image_label string, note string")
    path = documents.write_metadata({"images": images, "none": none}, str(tmp_path), "big one")
    doc = json.loads((tmp_path / "big_one_metadata.json").read_text())
    assert len(doc["images"]) == 5000 and doc["none"] == [] and doc["images"][0].keys() == {"image_label", "note"} and path.endswith("big_one_metadata.json")
    table = validate.Table("images", {"image_label": T.StringType(), "note": T.StringType()})
    for _ in range(2):
        back = documents.read_metadata(spark, path, {"images": table, "none": table, "absent": table})
        assert set(back) == {"images", "none"} and back["none"].isEmpty() and back["images"].exceptAll(images).isEmpty() and back["images"].count() == 5000
        monkeypatch.setattr(documents, "known_to_python", lambda path: False)  # read by Spark, split all the same
    pretty = tmp_path / "other_metadata.json"
    pretty.write_text(json.dumps({"images": [{"image_label": "a", "note": "é"}, {"image_label": None}]}, indent=4))
    assert [tuple(r) for r in documents.read_metadata(spark, str(pretty), {"images": table})["images"].collect()] == [("a", "é"), (None, None)]


def test_folders_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    """Level by level, as Spark's own listing has it: no hidden entries, no empty files."""
    names = ["a/b/c/d/x_Output_Cells.txt", "a/x_output_rings.TXT", "a b/+%20/y.JPEG", "a/annotated/z.jpg", "a/.hidden/h.jpg", "_tmp/h.jpg", "a/_h.jpg", "top.jpg", "other.txt"]
    for name in names:
        write(tmp_path / name, ["x"])
    (tmp_path / "a" / "empty.jpg").write_text("")
    (tmp_path / "nothing").mkdir()
    listed = measurements.listed_files(spark, str(tmp_path))
    key = lambda df: sorted(r[0] for r in df.select(measurements._key(measurements.F.col("path"))).collect())
    mine = key(listed)
    assert mine == sorted(f"{tmp_path}/{n}" for n in names if "/." not in n and not n.startswith("_") and "/_" not in n)
    found = {(r["stem"], r["kind"]) for r in measurements.found_files(spark, str(tmp_path)).collect()}
    assert found == {("x", "cells"), ("x", "rings"), ("y", "image"), ("top", "image")}
    monkeypatch.setattr(measurements, "known_to_python", lambda path: False)
    assert key(measurements.listed_files(spark, str(tmp_path))) == mine


def test_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    rows = [(f"{tmp_path}/f{k % 7}", k, f"{k}\n".encode()) for k in range(500)] + [(f"{tmp_path}/empty", 0, b"")]
    assert measurements.write_files(spark.createDataFrame(rows, "path string, nr int, value binary").repartition(5), ["nr"]) == 8
    assert sorted(p.name for p in tmp_path.iterdir()) == ["empty", *(f"f{k}" for k in range(7))]
    assert (tmp_path / "f3").read_text() == "".join(f"{k}\n" for k in range(3, 500, 7)) and (tmp_path / "empty").read_bytes() == b""
    held = {}
    for by_tasks in (True, False):  # an archive is the same, whoever writes it
        monkeypatch.setattr(archive, "_MADE", {})
        monkeypatch.setattr(measurements, "known_to_python", lambda path, known=by_tasks: known)
        out = Path(archive.folder(spark, "/root/testdata/sf0.001").removeprefix("file:"))
        held[by_tasks] = {str(p.relative_to(out)): sorted(p.read_bytes().split(b"\n")) for p in out.rglob("*") if p.is_file() and p.name[0] != "."}
    assert len(held[True]) > 40 and held[True] == held[False]


def odd_files(tmp_path):
    """In two far-apart folders: CID in the second place, old names, a missing, an empty and a broken file, short lines; and one beside that nobody names."""
    names = measurements.CELL_COLUMNS
    old = ["BEND" if c == "TB2" else "CA" if c == "LA" else c for c in names]
    a, b = tmp_path / "a b+c", tmp_path / "far" / "away"
    values = lambda y: [str(y), *(f"{k}.5" for k in range(1, len(names)))]
    write(a / "moved_Output_Cells.txt", ["\t".join(["ID", "CID", *reversed(names)]), "\t".join(["x", "77", *reversed(values(1999))])])
    write(b / "old_OUTPUT_cells.TXT", ["\t".join(f'"{c}"' for c in ["ID", *old]) + "\r", "\t".join(["x", *values(2000)]) + "\r", "", "\t".join(["x", *values("NA")]) + "\r"])
    write(b / "short_Output_Cells.txt", ["\t".join(["ID", *names]), "\t".join(["x", *values(2001)]), "x\t2002\t5", "x"])
    write(b / "broken_Output_Cells.txt", ["\t".join(["ID", *names[:-2]]), "\t".join(["x", *values(2001)])])
    write(a / "head_Output_Cells.txt", ["\t".join(["ID", *names])])
    (a / "empty_Output_Cells.txt").write_text("")
    write(tmp_path / "far" / "other_Output_Cells.txt", ["nobody", "asked"])
    where = {"moved": a / "moved_Output_Cells.txt", "old": b / "old_OUTPUT_cells.TXT", "gone": tmp_path / "no" / "gone_Output_Cells.txt", "unnamed": None}
    return where | {n: b / f"{n}_Output_Cells.txt" for n in ("short", "broken", "missing")} | {n: a / f"{n}_Output_Cells.txt" for n in ("head", "empty")}


PROBLEMS = {"broken": "no column CWA, RWD", "empty": "no file", "gone": "no file", "missing": "no file", "old": "no year", "short": "short line", "unnamed": "no file"}


def test_columns_by_name_and_failures_reported(spark, tmp_path):
    where = odd_files(tmp_path)
    data = spark.createDataFrame([(n, None if p is None else str(p)) for n, p in where.items()], "image_label string, fname_cells string")
    cells, failed = measurements.collect_cells(spark, data)
    got = {(r["image_label"], r["year"]): r for r in cells.collect()}
    assert sorted(got) == [("moved", 1999), ("old", 2000), ("short", 2001), ("short", 2002)]
    for key in [("moved", 1999), ("old", 2000), ("short", 2001)]:
        assert [got[key][c.lower()] for c in measurements.CELL_COLUMNS[1:]] == [k + 0.5 for k in range(1, 26)]
    assert got["short", 2002]["xpix"] == 5 and got["short", 2002]["rwd"] is None
    assert {r[0]: r[1] for r in failed.collect()} == PROBLEMS
    assert not any("other" in f for f in cells.inputFiles()) and len(cells.inputFiles()) == 6
    none, all_failed = measurements.collect_cells(spark, data.filter("image_label IN ('gone', 'unnamed')"))
    assert none.isEmpty() and all_failed.count() == 2


def test_labels_by_shuffle(spark, tmp_path, monkeypatch):
    where = odd_files(tmp_path)
    data = spark.createDataFrame([(n, None if p is None else str(p)) for n, p in where.items()], "image_label string, fname_cells string")
    monkeypatch.setattr(measurements, "BROADCAST_BYTES", 0)
    cells, failed = measurements.collect_cells(spark, data)
    assert cells.count() == 4 and {r[0]: r[1] for r in failed.collect()} == PROBLEMS


def test_large_folders_are_read_by_tasks(spark, folder, tmp_path, monkeypatch):
    """No folder of many entries is listed by the driver: plans have no file scan, and rows are the same."""
    where = odd_files(tmp_path)
    data = spark.createDataFrame([(n, None if p is None else str(p)) for n, p in where.items()], "image_label string, fname_cells string")
    settings = sets_with_labels(spark, folder)
    (folder / "SITEA_PISY_01A_1_2_ROXAS_Settings.txt").write_bytes(b'RNUM\tSETTING\tDESCRIPTION\r\n\r\n8\t"a b"\td\r\n17\t0\r\n10\t3.\xc3\xa9\n')
    rows = lambda df: sorted(map(repr, df.collect()))
    made = lambda: [measurements.collect_cells(spark, data)[0], measurements.collect_settings(spark, settings)]
    listed = [rows(df) for df in made()]
    monkeypatch.setattr(measurements, "LISTED_FILES", 5)
    cells, failed = measurements.collect_cells(spark, data)
    assert not cells.inputFiles() and {r[0]: r[1] for r in failed.collect()} == PROBLEMS
    assert [rows(df) for df in made()] == listed and len(listed[1]) == 2
    assert "FileScan csv" not in measurements.collect_settings(spark, settings)._jdf.queryExecution().toString()


def test_noted_files_are_counted_once(spark, tmp_path):
    arriving, notes = tmp_path / "arriving", str(tmp_path / "notes")
    for n, stems in enumerate((["a", "b"], ["c"])):
        for stem in stems:
            cells_file(arriving / f"{stem}_Output_Cells.txt", [2000, 2000, 2001])
        arrivals.note_arrived(spark, str(arriving), notes)
        counts = arrivals.ring_counts(arrivals.noted_cells(spark, notes))
        arrivals.count_arrived(counts, str(tmp_path / "out"), str(tmp_path / "at"))
        got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == [(s, y, c) for s in "abc"[: 2 + n] for y, c in ((2000, 2), (2001, 1))]
    assert spark.read.parquet(notes).count() == 3


def test_stream_reads_columns_by_name(spark, tmp_path):
    odd_files(tmp_path)
    for name, stream in (("cells", arrivals.cell_stream), ("problems", arrivals.problem_stream)):
        stream(spark, str(tmp_path)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"at_{name}")).option("path", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    cells = spark.read.parquet(str(tmp_path / "cells"))
    assert sorted(tuple(r) for r in cells.select("stem", "year", "la").collect()) == [("moved", 1999, 7.5), ("old", 2000, 7.5), ("short", 2001, 7.5), ("short", 2002, None)]
    problems = spark.read.parquet(str(tmp_path / "problems"))
    assert sorted((r["stem"], r["problem"]) for r in problems.collect() if r["stem"] != "other") == [("broken", "no column CWA, RWD"), ("old", "no year"), ("short", "short line"), ("short", "short line")]


def test_woodpieces_of_several_letters(spark):
    names = spark.createDataFrame([("SITEA_PISY_01AB_1_2.jpg",), ("SITÉ_PISY_01_1_2",), ("none",)], "name string")
    got = {r["name"]: r for r in structure.structure_from_names(names).collect()}
    assert got["SITEA_PISY_01AB_1_2.jpg"]["woodpiece_label"] == "SITEA_PISY_01_AB"
    assert got["SITÉ_PISY_01_1_2"]["site_label"] == "SITÉ" and got["SITÉ_PISY_01_1_2"]["woodpiece_label"] == "SITÉ_PISY_01"
    assert all(got["none"][c] is None for c in ("matched", "site_label", "species_code", *structure.LABELS))


def test_readers_refuse_what_is_not_whole(spark, tmp_path):
    write(tmp_path / "p.csv", ["image_label,year,sector_n,la_mean", "a,2000,1,1.5", "a,NA,2,1.5"])
    with pytest.raises(ValueError):
        measurements.read_profiles(spark, str(tmp_path / "p.csv"))
    write(tmp_path / "q.csv", ["image_label,year,sector_n", "a,2000,1"])
    with pytest.raises(ValueError):
        measurements.read_profiles(spark, str(tmp_path / "q.csv"))
    with pytest.raises(ValueError):
        measurements.read_ring_flags(spark, str(tmp_path / "p.csv"))
    with pytest.raises(ValueError):
        measurements.read_image_metadata(spark, str(tmp_path / "p.csv"))


def test_forced_validity(spark, tmp_path):
    table = validate.Table("t", {"a": T.StringType()}, {"a": validate.Rule("character", required=True)})
    documents.write_metadata({"t": spark.createDataFrame([(None,)], "a string")}, str(tmp_path), "x")
    assert documents.read_valid_metadata(spark, str(tmp_path), {"t": table}, force_valid=False)[1].count() == 1
    with pytest.raises(validate.SchemaError):
        documents.read_valid_metadata(spark, str(tmp_path), {"t": table})
    with pytest.raises(FileNotFoundError):
        documents.read_valid_metadata(spark, str(tmp_path), {"t": table}, "other")


def test_folders_are_shared(spark):
    from types import SimpleNamespace

    from cambium.sources import scratch

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(ValueError):
        scratch.shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default)))
    assert scratch.kept(spark.range(3)).count() == 3


def test_names(spark):
    names = spark.createDataFrame([("a/SITEA_PISY_01_1_2.jpg",), ("nothing",), ("b/SITEA_PISY_01_1_2.jpg",)], "name string")
    got = structure.structure_from_names(names)
    r = got.filter("name LIKE 'a%'").first()
    assert r["woodpiece_label"] == r["tree_label"] == "SITEA_PISY_01" and r["image_label"] == "SITEA_PISY_01_1_2"
    assert sorted((r["name"], r["problem"]) for r in structure.structure_problems(got).collect()) == [("a/SITEA_PISY_01_1_2.jpg", "duplicate"), ("b/SITEA_PISY_01_1_2.jpg", "duplicate"), ("nothing", "no match")]
    pattern = "(?<tree>[:alnum:]+)_(?<slide>[:alnum:]+)_(?<image>[:alnum:]+)"
    with pytest.raises(ValueError):
        structure.structure_from_names(names, pattern)
    own = structure.structure_from_names(spark.createDataFrame([("tree1_sl2_img1.jpg",)], "name string"), pattern, "SITEA", "PISY").first()
    assert own["tree_label"] == "SITEA_PISY_tree1" and own["image_label"] == "SITEA_PISY_tree1_sl2_img1"
    with pytest.raises(ValueError):
        structure.structure_from_names(names, site="X")
    assert structure.readable("(?<tree>a+)_(?<image>b)") == "{tree}_{image}"
    assert structure.file_name_of("  my data/set! ") == "my_data_set_" and structure.file_name_of("--") == "dataset"


def test_processed_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("a", 2000, 1, 2.5, "EW")], "image_label string, year int, xpix int, la double, ew_lw string")
    rings = spark.createDataFrame([("a", 2000, 3, True)], "image_label string, year int, cno int, missing_ring boolean")
    documents.write_table(cells, str(tmp_path), "demo", "cells", dt.date(2025, 1, 2), compress=True)
    documents.write_table(rings, str(tmp_path), "demo", "rings", dt.date(2025, 1, 2))
    back = measurements.read_processed(spark, str(tmp_path), "demo")
    assert back.cells.collect() == cells.collect() and back.rings.collect() == rings.collect()
    with pytest.raises(FileNotFoundError):
        measurements.read_processed(spark, str(tmp_path), "other")


@pytest.mark.parametrize("first", ["k", "-k"])
def test_a_large_table_is_written_stretch_by_stretch(spark, tmp_path, monkeypatch, first):
    """Whole and in order over all files, nulls last, whatever the stretches; one stretch's shuffles are gone before the next."""
    monkeypatch.setattr(documents, "_ROWS_EACH", 1)
    data = [(None if k % 97 == 0 else f"k{k * 37 % 1000:04}", k) for k in range(3000)]
    df = spark.createDataFrame(data, "k string, n int")
    written = []
    for size in (1 << 30, 8 << 10):
        monkeypatch.setattr(documents, "ROUND_BYTES", size)
        path = documents.write_table(df, str(tmp_path), "demo", "cells", documents.dt.date(2025, 1, 2), compress=True, order=[first, "n"], rows=df.select("k"))
        lines = []
        for file in sorted(Path(path).glob("part-*.gz")):
            lines += gzip.decompress(file.read_bytes()).decode().splitlines()[1:]
        written.append(lines)
        assert spark.read.csv(path, header=True).count() == 3000
    known = sorted(((k, n) for k, n in data if k), key=lambda r: r[1])
    known.sort(key=lambda r: r[0], reverse=first[0] == "-")
    assert written[0] == written[1] == [f"{k},{n}" for k, n in known] + [f"NA,{n}" for k, n in data if not k]
    assert len(documents._stretches(df.select("k"), first, 2)) == 6 and len(list(tmp_path.iterdir())) == 1


def test_schema_and_metadata(spark, tmp_path):
    base = {"type": "array", "items": {"type": "object", "properties": {"label": {"type": "string"}, "n": {"type": ["integer", "null"], "minimum": 1}, "day": {"type": "string", "format": "date"}}, "required": ["label"]}}
    (tmp_path / "base.json").write_text(json.dumps(base))
    (tmp_path / "ext.json").write_text(json.dumps({"allOf": [{"$ref": "base.json"}, {"items": {"properties": {"label": {"unique": True, "title": "Label"}}}}]}))
    table = validate.table_of("t", validate.resolve_schema(str(tmp_path / "ext.json")))
    assert table.required == ("label",) and table.rules["label"].unique and table.columns["n"] == T.IntegerType() and table.columns["day"] == T.DateType()
    df = spark.createDataFrame([("a", "0", "2020-01-01"), ("a", "x", "bad"), (None, "2.9", None)], "label string, n string, day string")
    aligned, warnings = validate.align_to_schema(df.withColumnRenamed("day", "other"), table)
    assert warnings == ["extra columns ignored in t"] and [r["n"] for r in aligned.collect()] == [0, None, 2]
    found = {(r["field"], r["severity"], r["message"]) for r in validate.violations(df, table).collect()}
    assert found == {("Label", "error", "Required, Non-unique values"), ("n", "error", "Out of range values"), ("day", "warning", "Invalid date formats")}
    with pytest.raises(validate.SchemaError):
        validate.align_to_schema(df.select("n"), table)
    assert validate.align_to_schema(df.select("n"), table, force_required=False)[1] == ["missing required columns in t: label"]
    assert validate.align_to_schema(df.select(df.n.alias("zz")), table, force_required=False)[0].count() == 1
    assert validate.align_to_schema(df.toDF("q", "w", "e"), table, by_position=True)[0].columns == ["label", "n", "day"]
    path = documents.write_metadata({"t": aligned}, str(tmp_path), "a b")
    again = documents.read_metadata(spark, path, {"t": table, "u": table})
    assert set(again) == {"t"} and again["t"].count() == 3
    with pytest.raises(validate.SchemaError):
        validate.validated_document({"$schema": df}, {"t": table}, "t")
    docs, said = validate.validated_document({"t": df}, {"t": table, "u": table}, "t")
    assert docs["t"].count() == 3 and said[0] == "missing tables: u"


def test_a_checkbox_without_a_maximum_may_be_checked_in_any_number_of_rows(spark):
    table = validate.table_of("t", {"items": {"properties": {"on": {"type": "boolean"}, "few": {"type": "boolean", "max_checks": 10}}}})
    df = spark.range(10_001).selectExpr("'true' AS on", "'true' AS few")
    assert [(r["field"], r["message"]) for r in validate.violations(df, table).collect()] == [("few", "Too many checked")]


def test_latest_schema_and_species(spark, tmp_path):
    for name in ("20240101_site_schema.json", "20250101_site_schema.json", "20260101_tree_schema.json"):
        (tmp_path / name).write_text("{}")
    assert validate.latest_schema(str(tmp_path), "site").endswith("20250101_site_schema.json")
    with pytest.raises(FileNotFoundError):
        validate.latest_schema(str(tmp_path), "slide")
    write(tmp_path / "species.csv", ["species_name,itrdb_species_code,phylogenetic_group,leaf_habit,tree_ring_structure,more", "Pinus sylvestris,PISY,g,e,n,x"])
    assert [tuple(r) for r in measurements.read_species(spark, str(tmp_path / "species.csv")).collect()] == [("Pinus sylvestris", "PISY", "g", "e", "n")]


def test_dataset_rules(spark):
    rows = [("ok", "fine", "public", None), ("", "[ADD INFO x]", "restricted", None), ("n" * 65, "", "public", "2030-01-01")]
    df = spark.createDataFrame(rows, "ds_name string, description string, ds_access string, embargoed_until string")
    got = sorted(tuple(r) for r in validate.dataset_problems(df).collect())
    assert got == sorted([("ds_name", "Required"), ("description", "Unfinished template"), ("embargoed_until", "Required"), ("ds_name", "Invalid lengths"), ("description", "Required"), ("embargoed_until", "Must be empty")])


def test_countries(spark, tmp_path):
    write(tmp_path / "c.csv", ["country_name,country_iso_code,combined", "Namibia,NA,Namibia (NA)"])
    assert measurements.read_countries(spark, str(tmp_path / "c.csv")).first()["country_iso_code"] == "NA"
    polygons = spark.createDataFrame([("AA", [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]), ("-99", [(10.0, 10.0), (12.0, 10.0), (12.0, 12.0)])], "code string, ring array<struct<lon:double,lat:double>>")
    sites = spark.createDataFrame([("in", 1.0, 1.0), ("box only", 3.5, 3.5), ("unknown", 11.5, 10.5), ("null", None, 1.0)], "site_label string, longitude double, latitude double")
    assert {r[0]: r[1] for r in structure.site_countries(sites, polygons).collect()} == {"in": "AA", "box only": "", "unknown": "", "null": ""}
    coords = spark.createDataFrame([("1", "2"), ("1.0", "2.0"), ("200", "1"), ("x", "1"), (None, "1")], "longitude string, latitude string")
    assert [tuple(r) for r in structure.site_coordinates(coords).collect()] == [(1.0, 2.0)]


def test_species(spark):
    trees = spark.createDataFrame([("t1", "PISY", None), ("t2", "XXXX", "own")], "tree_label string, species_code string, species_name string")
    known = spark.createDataFrame([("PISY", "Pinus sylvestris", "g", "e", "n")], "itrdb_species_code string, species_name string, phylogenetic_group string, leaf_habit string, tree_ring_structure string")
    got = {r["tree_label"]: r["species_name"] for r in structure.enrich_species(trees, known).collect()}
    assert got == {"t1": "Pinus sylvestris", "t2": "own"}


def test_stream(spark, folder, tmp_path):
    cells = tmp_path / "arriving"
    cells.mkdir()
    write(cells / "one_Output_Cells.txt", ["\t".join(["ID", *measurements.CELL_COLUMNS]), *("\t".join(["x", str(y), *["1"] * 25]) for y in (2000, 2000, 2001))])
    counts = arrivals.ring_counts(arrivals.cell_stream(spark, str(cells)))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.table("arrived").collect()) == [("one", 2000, 2), ("one", 2001, 1)]


def brute_within(x, y, rings):
    """Even-odd over all rings in exact fractions; not on an edge."""
    from fractions import Fraction as Q

    odd, (x, y) = False, (Q(x), Q(y))
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            ax, ay, bx, by = Q(ax), Q(ay), Q(bx), Q(by)
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return False
            odd ^= ((ay > y) != (by > y)) and x < ax + (y - ay) * (bx - ax) / (by - ay)
    return odd


@pytest.mark.parametrize("cell", [1.0, 0.37, 25.0])
def test_holes_islands_and_edges(spark, tmp_path, cell):
    import math
    import random

    rng = random.Random(11)

    def star(x, y, least, most, n):  # a ring that never crosses itself, on eighths of a degree
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        out = [(round((x + r * math.cos(t)) * 8) / 8, round((y + r * math.sin(t)) * 8) / 8) for t in turns for r in [rng.uniform(least, most)]]
        return out

    countries = {"AA": [star(0, 0, 6, 9, 40), star(0, 0, 3, 5, 30), star(0, 0, 1, 2, 12), star(20, 5, 1, 8, 25)], "BB": [star(0, 0, 3, 5, 30)], "CC": [[(-30.0, -5.0), (-20.0, -5.0), (-20.0, 5.0), (-30.0, 5.0)], [(-28.0, -3.0), (-22.0, -3.0), (-22.0, 3.0), (-28.0, 3.0)]]}
    text = lambda ring: "(" + ", ".join(f"{x} {y}" for x, y in [*ring, ring[0]]) + ")"
    kinds = {"AA": f"MULTIPOLYGON (({', '.join(text(r) for r in countries['AA'][:2])}), ({text(countries['AA'][2])}), ({text(countries['AA'][3])}))", "BB": f"POLYGON({text(countries['BB'][0])})", "CC": f"POLYGON (({text(countries['CC'][0])[1:-1]}),{text(countries['CC'][1])})"}
    write(tmp_path / "p.csv", ["code,wkt", *(f'{c},"{w}"' for c, w in kinds.items())])
    points = [(rng.uniform(-32, 30), rng.uniform(-12, 14)) for _ in range(600)] + [(rng.randint(-240, 240) / 8, rng.randint(-80, 104) / 8) for _ in range(1500)]
    corners = [p for rings in countries.values() for ring in rings for p in ring]
    points += corners + [(-30.0, 0.0), (-25.0, 5.0), (-24.0, -3.0), (-25.0, 0.0), (-29.0, 1.0), (-21.0, 5.0)]
    sites = spark.createDataFrame([(str(k), *p) for k, p in enumerate(points)] + [("nan", float("nan"), 1.0), ("far", 1e300, 0.0)], "site_label string, longitude double, latitude double")
    got = {r[0]: r[1] for r in structure.site_countries(sites, measurements.read_polygons(spark, str(tmp_path / "p.csv")), cell).collect()}
    want = {str(k): min((c for c, rings in countries.items() if brute_within(*p, rings)), default="") for k, p in enumerate(points)}
    assert got == want | {"nan": "", "far": ""}
    assert sum(v == "AA" for v in want.values()) > 100 and sum(v == "CC" for v in want.values()) > 20


def test_a_cell_holds_its_own_edges_only(spark):
    """The coastline of one polygon has 4,000 edges, of which no cell has more than a few."""
    ring = [(k / 100, 0.25 + k % 2 / 2) for k in range(2000)] + [(k / 100, 9.25 + k % 2 / 2) for k in reversed(range(2000))]
    index = structure.polygon_index(spark.createDataFrame([("AA", ring)], "code string, ring array<struct<lon:double,lat:double>>"), 1.0)
    sizes = {(r["cell_x"], r["cell_y"]): (len(r["edges"]), r["inside"]) for r in index.collect()}
    assert max(n for n, _ in sizes.values()) <= 110 and sizes[7, 5] == (0, 1) and len(sizes) <= 220
