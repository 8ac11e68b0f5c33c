"""Loading of folders of tracking files, clips and optional tables."""

import base64

import numpy as np
from kinetrail.sources import files


def test_folder_of_sessions(spark, tmp_path):
    head = "scorer,m,m,m\nbodyparts,nose,nose,nose\ncoords,x,y,likelihood\n"
    (tmp_path / "a_60fps_x.csv").write_text(head + "".join(f"{i},{i}.5,2,0.9\n" for i in range(12)))
    (tmp_path / "b.csv").write_text(head + "0,1,2,0.9\n")
    (tmp_path / "c.csv").write_text("nothing\n")
    paths = [str(tmp_path / n) for n in ("c.csv", "b.csv", "a_60fps_x.csv")]
    t, failed = files.load_source(spark, paths, 25.0)
    assert t.count() == 12 and t.first().fps == 60.0 and [f[1] for f in failed] == ["too short", "ValueError"]
    assert files.peek_bodyparts(spark, paths[2]) == ["nose"]
    assert files.load_source(spark, [])[0] is None and files.optional_table(spark, str(tmp_path / "none")) is None


def test_clips_and_videos(spark):
    names = ["group_3_example_1.mp4", "cluster_3_m1_example_2.mp4", "cluster_3_example_1.gif", "cluster_4_example_1.mp4", "other.mp4"]
    f = spark.createDataFrame([(f"/v/{n}", n, n.rsplit(".", 1)[0], n.rsplit(".", 1)[1]) for n in names] + [("/w/other.avi", "other.avi", "other", "avi")], "path string, name string, stem string, ext string")
    got = {r.cluster: (r.gif, len(r.mp4s)) for r in files.example_clips(f).collect()}
    assert got == {3: ("/v/cluster_3_example_1.gif", 2), 4: (None, 1)}
    assert files.video_of(f, "other", ["/w/", "/v/"]).first().path == "/w/other.avi" and files.video_of(f, "none", ["/v/"]).count() == 0
    assert files.decode_typed(base64.b64encode(np.array([1.5, 2], "<f4").tobytes()).decode(), "f4").tolist() == [1.5, 2.0]
    many = spark.range(5000)
    assert files.training_rows(many, "id").count() == 5000 and 1200 < files.training_rows(many, "id", full=100).count() < 1800
