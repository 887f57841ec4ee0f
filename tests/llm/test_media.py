import base64
import hashlib
import zlib

import numpy as np
import pytest
from callproof.llm import media, webp


@pytest.mark.parametrize("seed", range(40))
def test_all_transforms_round_trip(seed):
    rng = np.random.default_rng(seed)
    h, w = int(rng.integers(1, 40)), int(rng.integers(1, 50))
    base = rng.integers(0, 2**32, int(rng.integers(1, 400)), dtype=np.uint64).astype(np.uint32)
    px = base[rng.integers(0, len(base), (h, w))]
    if seed % 3 == 0:
        px = np.repeat(px[:, :1], w, 1)
    scale = int(rng.integers(2, 5))
    blocks = (-(-h >> scale), -(-w >> scale))
    kw = {"scale": scale, "cache_bits": int(rng.integers(0, 11)), "copies": bool(rng.random() < 0.7), "groups": int(rng.integers(1, 4))}
    if seed % 2 and len(np.unique(px)) <= 256:
        kw["palette"] = True
    else:
        kw |= {"predictor": rng.integers(0, 14, blocks), "cross": rng.integers(0, 2**32, blocks, dtype=np.uint64).astype(np.uint32), "green": bool(seed % 5)}
    back = webp.decode(webp.encode(px, **kw))
    assert back.shape == px.shape and (back == px).all()


def test_bulk_and_single_reading_agree():
    rng = np.random.default_rng(7)
    px = rng.integers(0, 40, 3000, dtype=np.uint64).astype(np.uint32)
    out = webp.Writer()
    webp.put_image(out, px, 50, cache_bits=4, top=True)
    a = webp.read_image(webp.Bits(out.data()), 50, 60, top=True)
    bits = webp.Bits(out.data())
    cache_bits = bits.read(4) if bits.read(1) else 0
    bits.read(1)
    b = webp.read_each(bits, 50, 3000, [webp.read_group(bits, cache_bits)], cache_bits)
    assert (a == px).all() and (b == px).all()


def test_near_distances():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and webp.NEAR[-1] == (8, 7)


def test_predictors_by_hand():
    one = lambda *c: np.array([c])
    args = [one(255, 10, 20, 30), one(255, 30, 20, 10), one(255, 1, 2, 3), one(255, 20, 20, 20)]
    want = {0: [255, 0, 0, 0], 1: [255, 10, 20, 30], 2: [255, 30, 20, 10], 3: [255, 1, 2, 3], 4: [255, 20, 20, 20], 7: [255, 20, 20, 20], 9: [255, 15, 11, 6], 12: [255, 20, 20, 20], 13: [255, 20, 20, 20]}
    for mode, out in want.items():
        assert webp.predicted(np.array([mode]), *args)[0].tolist() == out


@pytest.mark.parametrize("file,pixel", [("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", 0), ("UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=", 0xFFFFFFFF)])
def test_files_of_another_encoder(file, pixel):
    # published one-pixel samples, with which browsers test their support of the format
    assert webp.decode(base64.b64decode(file)).tolist() == [[pixel]]


def test_damaged_files_are_refused():
    good = webp.encode(np.arange(64, dtype=np.uint32).reshape(8, 8))
    with pytest.raises(ValueError):
        webp.decode(b"RIFX" + good[4:])
    with pytest.raises(ValueError):
        webp.decode(good[:16] + (12).to_bytes(4, "little") + good[20:32])


def test_query_columns(spark):
    texts = ["", None, "a", "a" * 64, "b" * 65, "héllo wörld 🙂 " * 50, "Repeat. " * 150_000, "Repeat. " * 3, "Repeat. " * 3]
    df = spark.createDataFrame([(k if k else None, t, b"x") for k, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = {r["doc_id"]: r for r in media.media_features(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (64 if not data else 0))
        r = got[k or None]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[7][1:] == got[8][1:] and got[None][1:] == got[1][1:]
    stored = media.with_media(df.select("doc_id", "text")).where("doc_id = 5").first()["media"]
    assert (len(stored), hashlib.sha256(stored).hexdigest()) == (got[5]["media_bytes"], got[5]["media_sha256"])
    assert media.media_features(df.limit(0)).count() == 0


@pytest.mark.parametrize("mode", [webp.LEFT, webp.ABOVE])
@pytest.mark.parametrize("size", [(1, 1), (1, 9), (7, 1), (12, 16)])
def test_lines_agree_with_fronts(monkeypatch, mode, size):
    h, w = size
    px = np.random.default_rng(h * w).integers(0, 2**32, h * w, dtype=np.uint64).astype(np.uint32)
    left = webp.predict_all(px, w, h, np.full(1, mode), 9, False)
    assert (webp.predict_all(left, w, h, np.full(1, mode), 9, True) == px).all()
    monkeypatch.setattr(webp, "LEFT", 98)
    monkeypatch.setattr(webp, "ABOVE", 99)
    assert (webp.predict_all(px, w, h, np.full(1, mode), 9, False) == left).all()


@pytest.mark.parametrize(
    "text,tools",
    [
        ("".join(np.random.default_rng(3).choice([*"aehinorst "], 256)), ""),
        ("The same line comes again and once more.    " * 30 + "but not at the end, zyxw 0123", "copies"),
        ("".join(np.random.default_rng(5).choice([f"{x}{y}{z} " for x in "btkw" for y in "aeiou" for z in "lmnr"], 400)), "cache"),
        ("".join(np.random.default_rng(6).choice([chr(0x3B1 + k) for k in range(17)], 900)), "predictor"),
        ("abc" * 500, "copies+palette"),
    ],
)
def test_forms_are_chosen_by_size(text, tools):
    payload = media.payload_of(text)
    stored = media.store(payload)
    assert b"".join(p.astype(">u4").tobytes() for p in media.images(stored)) == payload
    assert media.described(stored)[-1] == tools
    px = np.frombuffer(payload, ">u4").astype(np.uint32)
    if "palette" not in tools:
        for codes in (media.PLAIN, media.TOKENS):
            value, size = webp.coded(px, media.WIDTH, codes)
            out = webp.head(media.WIDTH, len(px) // media.WIDTH)
            out.put(codes.head.value, codes.head.size)
            file = webp.written(out, value, size)
            assert (webp.decode(file).ravel() == px).all() and len(stored) <= len(file)


@pytest.mark.parametrize("seed", range(20))
def test_copies_and_slots_round_trip(seed):
    rng = np.random.default_rng(seed)
    words = [bytes(rng.integers(97, 123, int(rng.integers(1, 30))).astype(np.uint8)) for _ in range(int(rng.integers(1, 60)))]
    data = b" ".join(words[k] for k in rng.integers(0, len(words), int(rng.integers(1, 3000))))
    if seed % 4 == 0:
        data += b"\0" * 40_000 + data
    payload = media.payload_of(data.decode())
    assert b"".join(p.astype(">u4").tobytes() for p in media.images(media.store(payload))) == payload


def test_alike_codes_share_one_table():
    """Plain text has one code for all channels; its table is looked up once for each bit."""
    out = webp.Writer()
    out.put(media.PLAIN.head.value, media.PLAIN.head.size)
    bits = webp.Bits(out.data(), 2)  # after the flags of cache and groups
    green, red, blue, alpha, _ = webp.read_group(bits, 0)
    assert green is red is blue is alpha
    assert webp.alike(np.array([1, 2, 2, 0]), np.array([1, 2, 2])) and not webp.alike(np.array([1, 2, 2]), np.array([1, 1]))


def test_colours_are_counted_only_where_few(monkeypatch):
    rich = media.payload_of("".join(np.random.default_rng(4).choice([*"aehinorst "], 200_000)))
    late = media.payload_of("abcd" * 64 + "".join(f"{k:04}" for k in range(200)))
    counted = []
    monkeypatch.setattr(media.np, "unique", lambda x, f=np.unique: counted.append(len(x)) or f(x))
    for payload, most in ((rich, 1000), (late, len(late))):
        counted.clear()
        stored = media.store(payload)
        assert sum(counted) <= most and b"".join(p.astype(">u4").tobytes() for p in media.images(stored)) == payload


@pytest.mark.parametrize("window", [64, 256, 4096])
def test_windows_join(monkeypatch, window):
    """Codes, copies and cache slots that end beyond a window are read on in the next."""
    texts = ["The same line comes again and once more.    " * 30 + "but not at the end, zyxw 0123", "".join(np.random.default_rng(3).choice([*"aehinorst "], 2560)), "".join(np.random.default_rng(6).choice([chr(0x3B1 + k) for k in range(17)], 900))]
    stored = [media.store(media.payload_of(x)) for x in texts]
    monkeypatch.setattr(webp, "WINDOW_BITS", window)
    for text, s in zip(texts, stored, strict=True):
        assert b"".join(p.astype(">u4").tobytes() for p in media.images(s)) == media.payload_of(text)


@pytest.mark.parametrize("seed", range(5))
def test_repeats_by_hand(seed):
    rng = np.random.default_rng(seed)
    px = rng.integers(0, 3, 300, dtype=np.uint64).astype(np.uint32) << np.uint32(8 * (seed % 4))
    back, last = [], {}
    for k in range(len(px) - 2):
        key = tuple(px[k : k + 3].tolist())
        back.append(k - last.get(key, k))
        last[key] = k
    got = [0] * len(back)
    for start, end, far in webp.repeats(px):
        got[start:end] = [far] * (end - start)
    assert got == back
