"""Command line and store."""

import numpy as np

from lacuna.__main__ import main
from lacuna.operators import codec as C
from lacuna.sources import media
from lacuna.store import ChunkStore, FieldView


def test_files_there_and_back(tmp_path, capsys):
    a = np.random.default_rng(0).integers(0, 256, (20, 12, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(media.write_png(a))
    p = lambda n: str(tmp_path / n)
    assert main(["encode", p("a.png"), p("c"), "--version", "2", "--blocks", "6"]) == 0
    assert main(["decode", p("c"), p("b.png")]) == 0 and (media.read_png((tmp_path / "b.png").read_bytes()) == a).all()
    assert main(["heal", p("c"), p("h")]) == 0 and main(["stack", p("s.png"), p("c"), p("h")]) == 0
    assert main(["sound-send", p("c"), p("c.wav"), "--uri", "x"]) == 0 and main(["sound-receive", p("c.wav"), p("r"), "--uri", "x"]) == 0
    assert main(["decode", p("r"), p("r.png")]) == 0 and (media.read_png((tmp_path / "r.png").read_bytes()) == a).all()
    capsys.readouterr()
    assert main(["decode", p("c"), p("d.png"), "--confidence"]) == 0 and capsys.readouterr().out.strip() == p("d_confidence.png")
    assert media.read_png((tmp_path / "d_confidence.png").read_bytes())[..., 0].tolist() == [[255, 127], [255, 127], [127, 63]]  # blocks cut by an edge count as such
    main(["frame-id", "stream-1", "7"])
    assert capsys.readouterr().out.strip() == "6bb7b5784127a1326e5129ef8c658ce7"
    (tmp_path / "none").mkdir()
    assert main(["decode", p("none"), p("n.png")]) == 1


def test_store(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 256, (16, 16, 3), dtype=np.uint8)
    rows = [("aa", i, n, bytearray(d), s) for i, (n, d, s) in enumerate(C.encode_image(a, 2, blocks=4))]
    chunks = spark.createDataFrame(rows, "cid string, chunk_id long, name string, data binary, score double")
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    store.put(chunks)
    store.put(chunks.limit(2))
    view = FieldView(store, "aa")
    assert store.count("aa") == 4 and view.coverage() == {"present": 4, "total": 4, "layout": "image"}
    assert (view.best()[0] == a).all()
    assert view.save(str(tmp_path / "v.png")) == str(tmp_path / "v_confidence.png") and (media.read_png((tmp_path / "v.png").read_bytes()) == a).all()
    sound = [("bb", i, n, bytearray(d), s) for i, (n, d, s) in enumerate(C.encode_audio(np.arange(64, dtype=np.int16).reshape(-1, 1), 8000, 2, blocks=4))][:2]
    store.put(spark.createDataFrame(sound, chunks.schema))
    curve = np.load(FieldView(store, "bb").save(str(tmp_path / "v.wav")))
    assert curve.dtype == np.float32 and curve.shape == (64,) and curve.mean() == 0.5
    store.drop("bb")
    assert [r["cid"] for r in store.contents().collect()] == ["aa"] and store.last_seen("aa") > 0
    store.purge(10, now=store.last_seen("aa") + 5)
    assert store.count("aa") == 4
    store.purge(1, now=store.last_seen("aa") + 5)
    assert store.count("aa") == 0 and view.best() is None
