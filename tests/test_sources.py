import hashlib
import io
import struct
import zipfile

import numpy as np
import pytest

from skytrail.operators import generators
from skytrail.sources import files, media, mesh, sinks, text


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_poses(spark, tmp_path):
    p = put(tmp_path / "env_1" / "traj_random.txt", "# head\n\n1 0 0 0 0 10 190\n2 1 1 1 0 0 -180\n# more\n1 5 5 5 0 20 90\n")
    got = {r.pose_id: r for r in text.read_poses(spark, p).collect()}
    assert got[1].x == 5 and got[1].env_id == "env_1" and got[2].kappa == -180
    s = {r.pose_id: r.a for r in text.states(text.read_poses(spark, p), "obstacle").collect()}
    assert s[1] == pytest.approx(np.radians(20), abs=1e-6)
    bad = put(tmp_path / "env_2" / "traj_random.txt", "1 2 3\n")
    with pytest.raises(Exception, match="bad line"):
        text.read_poses(spark, bad).collect()
    assert text.read_poses(spark, bad, strict=False).count() == 0


def test_instructions_stages_meta(spark, tmp_path):
    i = put(tmp_path / "e" / "instruction.txt", "7 0 9 fly  to the 塔\n8 10 12 land\n")
    rows = text.read_instructions(spark, i, with_env=False).orderBy("traj_id").collect()
    assert rows[0].instruction == "fly  to the 塔" and rows[0].length == 10 and rows[0].env_id == "e"
    v = put(tmp_path / "e" / "wash_res.txt", "8\n")
    kept = text.only_valid(text.read_instructions(spark, i, with_env=False), text.read_valid_ids(spark, v)).collect()
    assert [r.traj_id for r in kept] == [8]
    assert text.only_valid(text.read_instructions(spark, i, with_env=False), None).count() == 2
    s = put(tmp_path / "e" / "subtask.txt", "7 1 5 9 b\n7 0 0 4 a b\n")
    g = text.grouped_stages(text.read_stages(spark, s)).first()
    assert [x.text for x in g.stages] == ["a b", "b"]
    m = put(tmp_path / "e" / "traj_meta.txt", "1\tred roof\t0\t5\n2\tred roof\troof\t6\t9\n3 old mill 10 12\n4 13 14\n")
    got = {r.traj_id: (r.name, r.pose_start, r.pose_end) for r in text.read_trajectory_meta(spark, m).collect()}
    assert got[1] == ("red roof", 0, 5) and got[2][1:] == (6, 9) and got[3] == ("old mill", 10, 12) and got[4][1:] == (13, 14)


def test_outlines_and_landmarks(spark, tmp_path):
    put(tmp_path / "c" / "roof.txt", "0 0 1 r\n0 0 1 r\n4 0 2 r\n4 4 3 r\n")
    r = text.read_polylines(spark, str(tmp_path / "c"), "building").first()
    assert r.name == "roof" and len(r.pts) == 3 and r.target_z == 1.5
    put(tmp_path / "r" / "lane.txt", "0 0 1\n5 0 1\n0 0 1\n")
    assert len(text.read_polylines(spark, str(tmp_path / "r"), "road").first().pts) == 2
    p = put(tmp_path / "l" / "marks.txt", "#x y z label\n1.5 2 0 old tower，\nx y z no\n")
    rows = text.read_landmarks(spark, p).collect()
    assert [(r.x, r.y, r.label) for r in rows] == [(1.5, 2.0, "old tower")]


def test_xml(spark, tmp_path):
    m = put(tmp_path / "metadata.xml", "<ModelMetadata><SRS>ENU:30.5,114.25</SRS><SRSOrigin>1,2,3</SRSOrigin></ModelMetadata>")
    r = text.read_model_metadata(spark, m).first()
    assert (r.x, r.y, r.z, r.lat, r.lon, r.epsg) == (1, 2, 3, 30.5, 114.25, None)
    group = "<ImageDimensions><Width>400</Width><Height>300</Height></ImageDimensions><FocalLengthPixels>350.5</FocalLengthPixels><PrincipalPoint><x>200</x><y>150</y></PrincipalPoint>"
    photo = "<Photo><Id>{}</Id><ImagePath>a{}.jpg</ImagePath><Pose><Center><x>1</x><y>2</y><z>{}</z></Center></Pose></Photo>"
    b = put(tmp_path / "block.xml", f"<BlocksExchange><Block><Photogroups><Photogroup>{group}{photo.format(1, 1, 3)}{photo.format(2, 2, 4)}</Photogroup></Photogroups></Block></BlocksExchange>")
    i = text.read_intrinsics(spark, b).first()
    assert (i.width, i.fx, i.fy, i.cy) == (400, 350.5, 350.5, 150)
    assert sorted((r.photo, r.z) for r in text.read_cameras(spark, b).collect()) == [(1, 3.0), (2, 4.0)]


def test_meshes(spark, tmp_path):
    mesh.register(spark)
    head = "ply\nformat {}\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_bytes(head.format("binary_little_endian 1.0").encode() + struct.pack("<9f", *range(9)) + struct.pack("<B3i", 3, 0, 1, 2))
    (tmp_path / "b.ply").write_text(head.format("ascii 1.0") + "0 0 0\n1 1 1\n2 2 2\n3 2 1 0\n")
    rows = spark.read.format("ply").load(str(tmp_path / "*.ply")).orderBy("block", "i").collect()
    assert [(r.block, r.i, r.x) for r in rows] == [(0, 0, 0.0), (0, 1, 3.0), (0, 2, 6.0), (1, 0, 0.0), (1, 1, 1.0), (1, 2, 2.0)]
    assert mesh.ply_faces(str(tmp_path / "a.ply")) == [[0, 1, 2]] and mesh.ply_faces(str(tmp_path / "b.ply")) == [[2, 1, 0]]
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1/1 2//2 -1\nf 1 2\n")
    o = spark.read.format("obj").load(str(tmp_path / "m.obj")).filter("kind = 'f'").collect()
    assert [r.idx for r in o] == [[0, 1, 2]]


def test_rollouts_and_sheets(spark, tmp_path):
    d = tmp_path / "task_farm" / "test_unseen" / "openvla" / "env_9" / "episode_3"
    d.mkdir(parents=True)
    np.savez(d / "traj_gt_pred_xyzk.npz", gt_xyzk=np.ones((3, 4)), pred_xyzk=np.zeros((2, 5)))
    rows = files.read_rollouts(spark, str(tmp_path)).orderBy("frame_index").collect()
    assert (rows[0].task, rows[0].split, rows[0].env_id, len(rows)) == ("farm", "unseen", "env_9", 3) and rows[2].px is None
    buf = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="s"/></sheets></workbook>')
        cells = [[("Name", 1), ("X", 1), ("y", 1), ("z", 1)], [("tower", 1), (1.5, 0), (2, 0), (3, 0)], [("bad", 1), ("n/a", 1), (2, 0), (3, 0)]]
        xml = "".join("<row>" + "".join(f'<c r="{"ABCD"[i]}{n}" t="inlineStr"><is><t>{v}</t></is></c>' if t else f'<c r="{"ABCD"[i]}{n}"><v>{v}</v></c>' for i, (v, t) in enumerate(row)) + "</row>" for n, row in enumerate(cells, 1))
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{xml}</sheetData></worksheet>")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.xlsx").write_bytes(buf.getvalue())
    got = files.read_spreadsheets(spark, str(tmp_path / "x"), {"label": ["label", "name"], "x": ["x"], "y": ["y"], "z": ["z"]}).collect()
    assert [(r.label, r.x) for r in got] == [("tower", 1.5)]


def test_discovery(spark, tmp_path):
    for n in ("9", "10", "x"):
        (tmp_path / n).mkdir()
    put(tmp_path / "x" / "instruction.txt", "")
    assert files.largest_numbered(spark, str(tmp_path)).endswith("/10")
    assert files.environments(spark, str(tmp_path)) == ["x"]
    assert files.read_jsonl(spark, str(tmp_path / "no.jsonl"), "a int").count() == 0


def test_round_trip_of_generated_poses(spark, tmp_path):
    marks = spark.createDataFrame([("tower", 10.0, 20.0), ("mill", -5.0, 0.0)], "name string, x double, y double")
    paths = generators.landing(marks, per=2)
    p = generators.poses(paths).selectExpr("pose_id", "x", "y", "z", "180D omega", "0D phi", "degrees(yaw) kappa")
    f = str(tmp_path / "env_3" / "traj_random.txt")
    sinks.write_lines(spark, f, sinks.pose_lines(p), sinks.pose_header((0, 0, 0), {"width": 4, "height": 3, "fx": 2.0, "fy": 2.0, "cx": 2.0, "cy": 1.5}))
    back = text.read_poses(spark, f)
    assert back.count() == p.count() == p.selectExpr("max(pose_id) + 1").first()[0]
    assert text.intrinsics_of_header(spark, f).first().fov_x == pytest.approx(np.pi / 2)
    # Stages cover each trajectory without a gap.
    r = generators.stage_ranges(paths, 3)
    total = r.selectExpr("sum(pose_end - pose_start + 1)").first()[0]
    assert total == p.count()
    assert generators.stage_ranges(paths, 3, placeholders=True).groupBy("traj_id").count().filter("count <> 3").count() == 0


def test_episode_files(spark, tmp_path):
    f = spark.createDataFrame([(e, i, [0.0] * 4, [0.0] * 4, "e") for e in (0, 1, 1200) for i in range(3)], "episode_index long, frame_index long, state array<float>, actions array<float>, env_id string")
    sinks.write_episodes(f, str(tmp_path / "d"))
    assert sorted(str(x.relative_to(tmp_path / "d")) for x in (tmp_path / "d").rglob("*.parquet")) == ["data/chunk-000/episode_000000.parquet", "data/chunk-000/episode_000001.parquet", "data/chunk-001/episode_001200.parquet"]
    back = files.read_episodes(spark, str(tmp_path / "d"))
    assert sorted((r.episode_id, r.frame_index) for r in back.collect()) == [(e, i) for e in (0, 1, 1200) for i in range(3)]
    sinks.write_episodes(f.filter("episode_index = 1"), str(tmp_path / "d"), overwrite=True)
    assert len(list((tmp_path / "d").rglob("*.parquet"))) == 1
    with pytest.raises(Exception, match="already exists"):
        sinks.write_episodes(f, str(tmp_path / "d"))


def test_files_are_written_mirrored_and_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Many small files, without a call of the driver for each; nested, of any name, over ones that Hadoop wrote."""
    root, to = str(tmp_path / "a b"), str(tmp_path / "mirror")
    sinks.write_lines(spark, f"{root}/d1/x.txt", spark.createDataFrame([("old",)], "value string"))
    rows = [(f"d{i}/sub/größe {i}.txt" if i % 3 else f"d{i}/x.txt", f"text {i}".encode()) for i in range(40)] + [("d1/x.txt", b"new"), ("top.parquet", b"p"), ("d5/_hidden", b"h")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary").repartition(3)
    monkeypatch.setattr(type(df), "toLocalIterator", lambda *a, **k: pytest.fail("rows go through the driver"))
    media.write_files(df, root)
    monkeypatch.undo()
    assert {str(p.relative_to(root)): p.read_bytes() for p in (tmp_path / "a b").rglob("*") if p.is_file()} == dict(rows)
    assert spark.read.text(f"{root}/d1/x.txt").first()[0] == "new"
    put(tmp_path / "mirror" / "d2" / "sub" / "größe 2.txt", "stays")
    copied = media.mirror(spark, root, to)
    assert copied == sorted(p for p, _ in rows if p not in ("top.parquet", "d2/sub/größe 2.txt"))
    want = {p: hashlib.sha256(b"stays" if p == "d2/sub/größe 2.txt" else c).hexdigest() for p, c in rows if p not in ("top.parquet", "d5/_hidden")}
    assert {r.path.split("/mirror/")[1]: r.sha256 for r in files.manifest(spark, to).collect()} == want
    with pytest.raises(Exception, match="path and content"):
        media.write_files(spark.createDataFrame([("a", None)], "path string, content binary"), root)
    assert media.mirror(spark, str(tmp_path / "none"), to) == []


def test_files_of_lines_are_read_in_splits_and_written_in_one_pass(spark, tmp_path, monkeypatch):
    """Order and line numbers hold over the splits of a file; no row goes through the driver."""
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda *a, **k: pytest.fail("rows go through the driver"))
    rows = spark.range(5000).selectExpr("concat('env ', id % 2) env_id", "id", "concat(id, ' ', repeat('x', cast(id % 7 as int))) value").repartition(7)
    sinks.write_line_files(spark, str(tmp_path), "a.txt", rows.orderBy("env_id", "id").select("env_id", "value"), "env_id", "# head\n", ["env 1", "env 2"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["env 0", "env 1", "env 2"]
    for k in (0, 1):
        assert (tmp_path / f"env {k}" / "a.txt").read_text() == "# head\n\n" + "".join(f"{i} {'x' * (i % 7)}\n" for i in range(k, 5000, 2))
    assert (tmp_path / "env 2" / "a.txt").read_text() == "# head\n\n"
    sinks.write_lines(spark, str(tmp_path / "one.txt"), rows.orderBy("id").select("value"), "h")
    assert (tmp_path / "one.txt").read_text() == "h\n" + "".join(f"{i} {'x' * (i % 7)}\n" for i in range(5000))
    put(tmp_path / "two.txt", "  1 a\r\n\r\n#  c\r\n2 b \r\n\n3 d")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        got = text.lines(spark, [str(tmp_path / n) for n in ("one.txt", "two.txt", "env 1/a.txt")])
        assert got.rdd.getNumPartitions() > 20
        got = {(r.file.rsplit("/", 1)[1], r.line_no): r.line for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {("one.txt", i + 1): f"{i} {'x' * (i % 7)}".strip() for i in range(5000)} | {("one.txt", 0): "h"}
    want |= {("two.txt", 0): "1 a", ("two.txt", 3): "2 b", ("two.txt", 5): "3 d"}
    want |= {("a.txt", i // 2 + 2): f"{i} {'x' * (i % 7)}".strip() for i in range(1, 5000, 2)}
    assert got == want
    assert [r.line for r in text.headers(spark, str(tmp_path / "two.txt")).collect()] == ["#  c"]


def test_images_are_read_by_few_tasks(spark, tmp_path):
    """Not a task for every few files; nested ones count, other names and hidden ones do not."""
    png = media.encode_png(np.zeros((2, 3, 3), np.uint8))
    for n in [f"pose_{i}.png" for i in range(300)] + ["sub/pose_300.png", "a.txt", "_x.png"]:
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(png)
    got = files.read_images(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() <= 4
    rows = got.collect()
    assert sorted(r.pose_id for r in rows) == list(range(301)) and all(bytes(r.content) == png and r["size"].width == 3 for r in rows)
    assert files.read_images(spark, f"{tmp_path}/s*").count() == 1
