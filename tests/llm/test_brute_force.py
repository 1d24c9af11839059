"""The fast paths of the classifiers, language labels and media features against plain loops."""

import hashlib
import math
import struct
import zipfile
import zlib

import numpy as np

from tickline.llm import langid, media, quality, toxicity
from tickline.llm.common import Memo

TEXTS = ["", "one", "You are a FOOL, a fool!", "nice day today and nice weather", "a a a b", "Straße über Öl", "word " * 300, "x" * 90, None, "tab\there\nline two"]
LONG = [f"{'good' if i % 2 else 'bad'} text number {i} with {'kind' if i % 2 else 'awful'} words {'and more' * (i % 5)}" for i in range(60)]


def test_quality_scores_word_by_word():
    w, bias = quality.fit_ftrl(LONG, [i % 2 for i in range(60)])
    got = quality.scorer((w, bias))(TEXTS, Memo(quality._codes))
    top = 1 << 64
    at = lambda x, kind: ((x + kind) * int(quality.MIX) % top) >> (64 - quality.BITS)
    for text, score in zip(TEXTS, got, strict=True):
        codes = [quality._codes(x) for x in (text or "").split()]
        grams = [at(c >> 32, 1) for c in codes] + [at(c & 0xFFFFFFFF, 2) for c in codes]
        for a, b in zip(codes, codes[1:], strict=False):
            grams += [at(((a >> 32) * 31 + (b >> 32)) % top, 3), at(((a & 0xFFFFFFFF) * 31 + (b & 0xFFFFFFFF)) % top, 4), at(int(a >> 32 == b >> 32), 5)]
        z = bias + 5.0 * sum(float(w[g]) for g in grams) / max(1, len(grams))
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-9, text


def test_toxicity_scores_do_not_depend_on_neighbours():
    model = toxicity.fit_net(LONG, [i % 2 for i in range(60)], ["en", "de"] * 30)
    net = toxicity.Net.__new__(toxicity.Net)
    net.p = model["net"]
    packed, starts = toxicity._packed(TEXTS, Memo(toxicity._buckets))
    got = net.raw(toxicity._tokens(packed), starts)
    p = model["net"]
    for text, score in zip(TEXTS, got, strict=True):
        words = [toxicity._buckets(x) for x in (text or "").split()]
        x = [sum(p["e"][c >> toxicity.BITS * k & (1 << toxicity.BITS) - 1] for k in range(3)) for c in words] + [np.zeros(toxicity.DIM, np.float32)] * max(toxicity.WIDTHS)
        h = []
        for k, w in enumerate(toxicity.WIDTHS):
            own = [sum(x[i + j] @ p[f"w{w}"][j] for j in range(w)) for i in range(len(x) - w + 1)]
            h.append(np.max(own, axis=0) + p["b"][k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS])
        z = float(np.maximum(np.concatenate(h), 0) @ p["v"] + p["c"][0])
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-4, text


def test_language_labels_position_by_position():
    words = [(s, y) for y, lang in enumerate((["the", "and", "house", "water"], ["der", "und", "haus", "wasser"])) for w in lang for s in langid.segments(w)]
    p = langid.train(words * 20, 2)
    texts = [t for t in TEXTS if t and any(map(str.isalpha, t))]
    got = langid.Labeller(p, 2).pooled(texts)
    for text, row in zip(texts, got, strict=True):
        all_positions = [langid.positions(p, np.frombuffer(s, np.uint8)[:, None])[:, 0] for w in text.split() for s in langid.segments(w)]
        assert np.abs(np.concatenate(all_positions).mean(0) - row).max() < 1e-4, text


def test_media_columns_byte_by_byte(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in media.media_columns(docs).collect():
        data = (TEXTS[r.doc_id] or "").encode()
        payload = list(data + b"\xff" * ((-len(data)) % 576 if data else 576))
        n = len(payload)
        mean, cells = sum(payload) / n, [payload[i * n // 64 : (i + 1) * n // 64] for i in range(64)]
        variance = sum(x * x for x in payload) / n - mean**2
        bits = sum(1 << i for i, c in enumerate(cells) if sum(c) * 64 > sum(payload))
        rising = sum(b > a for a, b in zip(payload, payload[1:], strict=False)) / n
        assert r.feature == f"{mean:.6f}:{variance:.6f}:{rising:.6f}:{bits:016x}"
        image = media.encode_png(bytes(payload), len(data))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        at = image.index(b"IDAT")
        (size,) = struct.unpack(">I", image[at - 4 : at])
        raw = zlib.decompress(image[at + 4 : at + 4 + size])
        assert b"".join(raw[k + 1 : k + 577] for k in range(0, len(raw), 577)) == bytes(payload)


def test_archives_hold_what_the_manifest_says(spark, tmp_path):
    docs = spark.createDataFrame([(i, "text " * i) for i in range(40)], "doc_id long, text string").repartition(2)
    rows = media.store(docs, f"file://{tmp_path}", 4000).collect()
    assert sum(r.members for r in rows) == 40 and all(len(zipfile.ZipFile(r.path).namelist()) == r.members for r in rows)
