"""Files on disk against what a document says of them."""

import hashlib

from loomline.sources import assets

PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff"


def test_asset_faults(spark, tmp_path):
    files = {"a.png": PNG + b"1", "deep/b.jpg": JPEG + b"2", "c.png": JPEG, "d.mp4": b"4", "e.jpeg": JPEG}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty.gif").write_bytes(b"")
    sha = {k: hashlib.sha256(v).hexdigest() for k, v in files.items()}
    rows = [
        ("a.png", sha["a.png"], "image/png", None),
        ("a.png", sha["a.png"], "image/jpeg", assets.TYPE),
        ("deep/b.jpg", sha["deep/b.jpg"], "image/jpg", None),
        ("e.jpeg", sha["e.jpeg"], "image/jpeg", None),
        ("e.jpeg", None, "image/jpeg", assets.HASH),
        ("c.png", sha["c.png"], "image/png", assets.TYPE),
        ("c.png", sha["c.png"], None, None),
        ("d.mp4", "0", "video/mp4", assets.HASH),
        ("empty.gif", hashlib.sha256(b"").hexdigest(), None, assets.MISSING),
        ("gone.png", "0", None, assets.MISSING),
        ("../a.png", "0", None, assets.OUTSIDE),
        ("x/../a.png", "0", None, assets.OUTSIDE),
        ("/a.png", "0", None, assets.OUTSIDE),
        ("file:a.png", "0", None, assets.OUTSIDE),
        (None, "0", None, assets.OUTSIDE),
    ]
    claimed = spark.createDataFrame([r[:3] for r in rows], "path string, sha256 string, mime_type string")
    found = assets.read_assets(spark, str(tmp_path))
    assert {r.path: (r.size, r.sha256) for r in found.collect()} == {k: (len(v), sha[k]) for k, v in files.items()}
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in assets.asset_faults(claimed, found).collect()), key=key) == sorted((r for r in rows if r[3]), key=key)
