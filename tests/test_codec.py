"""Codec invariants: exact round trips, errors that fall with every chunk, recovery, healing, stacking."""

import numpy as np
import pytest

from lacuna.functions import bytes as B
from lacuna.functions import gf256, transforms
from lacuna.functions import golden_np as G
from lacuna.operators import codec as C
from lacuna.operators import coarse, packed
from lacuna.operators.recovery import pack_recovery, unpack_recovery
from lacuna.sources import media


def noise(n, m, seed):
    return np.random.default_rng(seed).integers(0, 256, (n, m, 3), dtype=np.uint8)


def tone(hz, n, amplitude):
    return np.rint(amplitude * np.sin(2 * np.pi * hz * np.arange(n) / 8000)).astype(np.int16).reshape(-1, 1)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 101, 256])
def test_permutation_is_a_bijection(n):
    assert sorted(G.permutation(n)) == list(range(n))


@pytest.mark.parametrize("version", [1, 2])
def test_full_sets_are_exact(version):
    a = noise(17, 11, 0)
    assert (C.render(C.gather(C.encode_image(a, version, blocks=8))) == a).all()
    x = tone(440, 512, 12000)
    assert (C.render(C.gather(C.encode_audio(x, 8000, version, blocks=6, coarse_max_frames=64))) == x).all()


def test_errors_fall_with_more_chunks():
    a = noise(32, 32, 1)
    for version in (2, 3):
        chunks = C.encode_image(a, version, blocks=12, quality=60, coarse_max_side=10)
        e = [C.error(a, C.render(C.gather(chunks, most=k))) for k in (1, 3, 6, 12)]
        assert all(p >= q - 1e-9 for p, q in zip(e, e[1:]))
    x = tone(220, 1024, 9000)
    chunks = C.encode_audio(x, 8000, blocks=8, quality=60, n_fft=128, coarse_max_frames=128)
    e = [C.error(x[1:], C.render(C.gather(chunks, most=k))[1:]) for k in (1, 3, 6, 8)]
    assert all(p >= q - 1e-9 for p, q in zip(e, e[1:]))


@pytest.mark.parametrize("quality", [10, 25, 49, 50, 90])
@pytest.mark.parametrize("block", [4, 8, 16])
def test_images_at_all_qualities_and_block_sizes(quality, block):
    a = noise(32, 32, 11)
    chunks = C.encode_image(a, 3, blocks=12, quality=quality, dct_block=block, coarse_max_side=10)
    e = [C.error(a, C.render(C.gather(chunks, most=k)), "psnr") for k in (1, 3, 6, 12)]
    # the floor of quality 10 at 8 x 8 blocks is what its steps of up to 605 leave of noise
    assert all(q >= p - 1e-6 for p, q in zip(e, e[1:])) and e[-1] > (11 if (block, quality) == (8, 10) else 14)


@pytest.mark.parametrize("quality,n_fft", [(1, 64), (30, 64), (60, 128)])
def test_spectral_sounds_are_not_clipped(quality, n_fft):
    x = tone(220, 1024, 9000)
    chunks = C.encode_audio(x, 8000, blocks=8, quality=quality, n_fft=n_fft, coarse_max_frames=128)
    f = C.gather(chunks)
    signal, noise_ = (float((v.astype(float) ** 2).sum()) for v in (x, C.render(f).astype(float)[1:-n_fft] - x[1:-n_fft]))
    assert np.abs(f.vec).max() < 32767 and 10 * np.log10(signal / max(noise_, 1e-9)) > 60
    assert all(d[7] == 0 and f.coarse[4] == 2 and f.coarse[6] == 0 for _, d, _ in chunks)
    loud = np.where(np.arange(2048) % 2, 32767, -32768).astype(np.int16).reshape(-1, 1)
    burst = C.encode_audio(loud, 8000, blocks=4, quality=100, n_fft=2048, coarse_max_frames=2)
    assert burst[0][1][7] == C.gather(burst).coarse[6] == int(np.abs(C.gather(burst).vec.astype(int)).max() >= 32767)


@pytest.mark.parametrize("name", ["downsample", "latent_lowfreq", "ae_latent"])
def test_coarse_models(name):
    a, x = noise(24, 20, 3), tone(220, 1024, 900)
    whole = C.render(C.gather(C.encode_image(a, 3, blocks=8, model=name, quality=90)))
    assert C.error(a, whole, "psnr") > 25
    chunks = C.encode_audio(x, 8000, blocks=8, n_fft=128, model=name)
    assert C.error(x[1:-128], C.render(C.gather(chunks))[1:-128]) < 2
    assert C.gather(chunks).meta()[0] == name


def test_latent_weights(tmp_path):
    r = np.random.default_rng(0)
    flat = [np.repeat(np.repeat(r.integers(0, 256, (2, 2, 3)), 8, 0), 8, 1).astype(np.uint8) for _ in range(40)]
    model = coarse.LatentImage({"input_shape": np.array([4, 4, 3])})
    weights = coarse.train_latent(np.stack([model.view(a) for a in flat]), 12, (4, 4, 3))
    np.savez(tmp_path / "w.npz", **weights)
    model.load(str(tmp_path / "w.npz"))
    payload = model.encode(flat[0])
    n, k = model.HEADER.unpack_from(payload)
    assert k and len(payload) == 8 + n + k
    plain = coarse.LatentImage()
    assert np.abs(model.decode(payload, (16, 16, 3)) - flat[0].astype(int)).mean() < 40
    assert (plain.decode(payload, (16, 16, 3)) == coarse.get("downsample", "image").decode(payload[8 : 8 + n], (16, 16, 3))).all()
    model.load(str(tmp_path / "none.npz"))
    assert model.weights is None
    with pytest.raises(ValueError):
        plain.decode(payload[:12], (16, 16, 3))


def test_stack_aligns_on_the_coarse_view():
    r = np.random.default_rng(6)
    scene = np.kron(r.integers(0, 256, (12, 12, 1)), np.ones((8, 8, 3))).astype(np.uint8)
    moved = np.roll(scene, (8, -16), (0, 1))
    fields = [C.gather(C.encode_image(a, 3, blocks=6, quality=90, coarse_max_side=96)) for a in (scene, moved)]
    together = C.stack(fields).astype(int)
    assert np.abs(together - scene)[16:-16, 16:-16].mean() < 3 < np.abs(C.stack(fields, align=False).astype(int) - scene)[16:-16, 16:-16].mean()


def test_packed_objects():
    a, b, x = noise(24, 16, 1), noise(9, 30, 2), tone(330, 700, 8000)
    files = packed.pack([("image", a, 0), ("audio", x, 8000), ("image", b, 0)], blocks=9)
    for place, want in enumerate((a, x, b)):
        kind, got, rate = packed.unpack(files, place)
        assert (got == want).all() and rate == (8000 if kind == "audio" else 0)
    left = {n: d for n, d in files.items() if not n.startswith("chunk_") or int(n[6:10]) % 3}
    assert len(left) < len(files) and 0 < C.error(a, packed.unpack(left, 0)[1]) < C.error(a, np.zeros_like(a))
    broken = files | {"chunk_0000.bin": b"junk", "chunk_0001.bin": files["chunk_0001.bin"][:-3]}
    assert packed.unpack(broken, 0)[1].shape == a.shape
    for bad in (b"", b"HOPK", files["chunk_0000.bin"][:20], b"HOCH" + files["chunk_0000.bin"][4:]):
        assert packed.parse(bad) is None
    with pytest.raises(IndexError):
        packed.unpack(files, 3)
    with pytest.raises(ValueError):
        packed.pack([])


def test_packed_tables(spark):
    a, x = noise(8, 8, 1), tone(330, 300, 8000)
    rows = [(p, i, k, list(v.shape), r, bytearray(v.tobytes())) for p in (1, 2) for i, (k, v, r) in enumerate((("image", a, 0), ("audio", x, 8000)))]
    objects = spark.createDataFrame(rows, packed.OBJECTS)
    back = packed.unpack_objects(packed.pack_objects(objects, blocks=5))
    key = lambda r: (r["pack"], r["place"])
    assert sorted(back.collect(), key=key) == sorted(objects.collect(), key=key)
    assert packed.unpack_objects(packed.pack_objects(objects, blocks=5).where("name != 'manifest.json'")).count() == 0


def test_transform_quality_and_size():
    a = noise(24, 24, 10)
    assert C.error(a, C.render(C.gather(C.encode_image(a, 3, blocks=10, quality=50, coarse_max_side=8))), "psnr") > 20


def test_recovery_restores_all():
    for encode, signal in ((lambda s: C.encode_image(s, 3, blocks=12, overhead=0.5, seed=123), noise(32, 32, 21)), (lambda s: C.encode_audio(s, 8000, blocks=12, n_fft=128, overhead=0.5, seed=123, coarse_max_frames=64), tone(330, 1024, 12000))):
        chunks = encode(signal)
        data, coded = [c for c in chunks if c[0].startswith("chunk")], [c for c in chunks if not c[0].startswith("chunk")]
        full = C.render(C.gather(data))
        assert (C.render(C.gather(data[5:] + coded)) == full).all()
        assert (C.render(C.gather(data[5:] + coded, use_recovery=False)) != full).any()


def test_confidence_grows():
    for chunks in (C.encode_image(noise(24, 24, 31), 3, blocks=8), C.encode_image(noise(20, 20, 31), 2, blocks=8), C.encode_audio(tone(220, 512, 9000), 8000, blocks=8, n_fft=64)):
        means = [C.confidence(C.gather(chunks, most=k)).mean() for k in (1, 4, 8)]
        assert means[0] <= means[1] <= means[2] <= 1 + 1e-6
    assert C.confidence(C.gather(C.encode_image(noise(24, 24, 31), 3, blocks=8))).shape == (3, 3)


def test_best_chunks_beat_first_chunks():
    a = noise(32, 32, 41)
    chunks = C.encode_image(a, 3, blocks=16)
    by_name, by_gain = (C.error(a, C.render(C.gather(chunks, 4, g))) for g in (False, True))
    assert by_gain <= by_name + 1.0


def test_healing_settles():
    chunks = C.encode_image(noise(24, 24, 51), 3, blocks=8)[2:]
    _, deltas, _ = C.heal_fixed_point(chunks, rounds=3, tol=1e-4)
    assert all(a >= b - 1e-9 for a, b in zip(deltas, deltas[1:]))


def test_stack_of_complementary_halves_is_whole():
    chunks = C.encode_image(noise(24, 24, 5), 3, blocks=8)
    whole = C.render(C.gather(chunks))
    assert (C.stack([C.gather(chunks[::2]), C.gather(chunks[1::2])], align=False) == whole).all()


def test_damaged_chunks_are_left_out():
    chunks = C.encode_image(noise(16, 16, 3), 2, blocks=4)
    bad = [("chunk_0000.bin", b"junk", 0.0), (chunks[1][0], chunks[1][1][:-5], 0.0)]
    assert C.gather(bad) is None and C.gather(bad + chunks[2:]) is not None
    assert C.gather([]) is None


def test_published_vectors():
    """Wire vectors of the format."""
    cid = bytes.fromhex("c45da5fabae44317c8745e0879825bf9")
    assert B.DATA_HEADER.pack(B.DATA, cid, 7, 0, 1, 5).hex() + b"hello".hex() == "484f4454c45da5fabae44317c8745e0879825bf900000007000000010000000568656c6c6f"
    slices = np.array([[1, 2, 3, 4], [5, 6, 7, 8]], np.uint8)
    coefs = np.random.default_rng(7).integers(1, 256, size=2, dtype=np.uint8)[None]
    raw = pack_recovery(1, 3, 2, 0, 4, coefs[0].tobytes(), gf256.combine(coefs, slices)[0].tobytes())
    assert raw.hex() == "484f52430101030000000002000000000000000400000002000000048b4af4aa6b7c"
    assert unpack_recovery(raw)["coded_id"] == 0 and unpack_recovery(raw[:-1]) is None and unpack_recovery(b"") is None


def test_field_arithmetic():
    a = np.arange(1, 256)
    assert (gf256.mul(a, gf256.inv(a)) == 1).all()
    m = np.random.default_rng(0).integers(0, 256, (5, 5), dtype=np.uint8)
    x = np.random.default_rng(1).integers(0, 256, (5, 7), dtype=np.uint8)
    solved, rank = gf256.solve(m, gf256.combine(m, x))
    assert rank < 5 or (solved == x).all()
    assert gf256.solve(np.zeros((2, 2), np.uint8), np.zeros((2, 3), np.uint8))[0] is None


def test_media_round_trips():
    a = noise(9, 7, 2)
    assert (media.read_png(media.write_png(a)) == a).all()
    x = tone(100, 50, 1000)
    back, rate = media.read_wav(media.write_wav(x, 8000))
    assert rate == 8000 and (back == x).all()
    assert len(media.resample(np.arange(10.0), 8000, 16000)) == 20
    with pytest.raises(ValueError):
        media.read_png(b"nothing")


def test_transforms():
    t = transforms.dct_basis(8)
    assert np.allclose(t @ t.T, np.eye(8))
    assert transforms.zigzag(3).tolist() == [0, 1, 3, 6, 4, 2, 5, 7, 8]
    a = np.random.default_rng(4).normal(size=(16, 16))
    assert transforms.gauge_shift(np.roll(a, (2, -1), (0, 1)), a) == (2, -1)
