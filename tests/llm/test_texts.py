"""Token counts, transducer, packing, GIF and licences."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tessera.llm import gif, licenses, packing, pieces, token_count, wfst
from tessera.llm._words import IdStore, WordCache, char_ngrams, joined

from .fixtures import DOCS, docs, prose, rows_of

MODEL = pieces.model_path()
ODD = ["", " ", "  two  spaces ", "\n\t", "▁ mark▁s", "日本語 テキスト", "🙂🙂 x", "é́ combining", "tail  ", "a" * 300, "The quick brown fox, isn't it? 3.14"]


def _unigram():
    """The same pieces in the public tokenizers library's Unigram model."""
    import sentencepiece
    from tokenizers import Tokenizer, models

    model, scores = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load(MODEL).scores
    vocabulary = [(model.id_to_piece(i), scores.get(model.id_to_piece(i), (i, 0.0))[1]) for i in range(model.vocab_size())]
    return Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))


def _split(ids, sizes):
    at = np.concatenate(([0], np.cumsum(sizes)))
    return [ids[at[i] : at[i + 1]].tolist() for i in range(len(sizes))]


def _random_texts(n):
    rng, letters = random.Random(2), "abcdethe aaiinn▁ \n.,é0123日"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_unigram_paths_and_counts_equal_the_tokenizer():
    oracle, coder, counts = _unigram(), wfst.Encoder(MODEL, "unigram"), token_count.unit_counts(MODEL)
    texts = ODD + [t or "" for _, t in DOCS] + [prose(i, 30) for i in range(20)] + _random_texts(200)
    ids, sizes = coder.encode(texts)
    assert token_count.count_texts(texts, counts).tolist() == sizes.tolist()
    for text, own in zip(texts, _split(ids, sizes), strict=True):
        assert own == (oracle.encode(pieces.normalise(text)).ids if text else [])


def test_byte_pair_paths_equal_sentencepiece():
    import sentencepiece

    oracle = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ODD + [t or "" for _, t in DOCS] + [prose(i, 30) for i in range(20)] + _random_texts(2000)
    for text, own in zip(texts, _split(*wfst.Encoder(MODEL).encode(texts)), strict=True):
        assert own == oracle.encode(text)
        assert wfst.decode_ids(own, MODEL) == text.replace("▁", " ")
    with pytest.raises(ValueError):
        wfst.Transducer(pieces.load(MODEL), "word")


def test_wfst_frames(spark):
    coded = wfst.encode(docs(spark), MODEL)
    want = sorted(((i, (t or "").replace("▁", " ")) for i, t in DOCS), key=repr)
    assert rows_of(wfst.decode(coded, MODEL)) == want
    digests = {r["doc_id"]: r for r in wfst.digest(coded, MODEL).collect()}
    assert digests[5]["n_pieces"] == 0 and digests[9]["text_sha256"] == hashlib.sha256(b"one two").hexdigest()
    by_unigram = wfst.digest(wfst.encode(docs(spark), MODEL, kind="unigram"), MODEL)
    assert sorted(r["n_tokens"] for r in token_count.count_tokens(docs(spark), MODEL).collect()) == sorted(r["n_pieces"] for r in by_unigram.collect())
    assert wfst.encode(docs(spark, []), MODEL).collect() == [] and token_count.count_tokens(docs(spark, []), MODEL).collect() == []


def test_word_cache_stays_bounded_and_exact():
    seen = []
    cache = WordCache(lambda ws: (seen.append(len(ws)), np.array([len(w) for w in ws], np.int64))[1], limit=50)
    rng = random.Random(1)
    for _ in range(200):
        words = ["w" * rng.randint(1, 20) + str(rng.randint(0, 30)) for _ in range(30)]
        rows, table = cache.lookup(words)
        assert table[rows].tolist() == [len(w) for w in words]
        assert len(cache) <= 50 + 30
    store = IdStore(lambda ws: joined([[ord(c) for c in w] for w in ws]), limit=20)
    for _ in range(100):
        words = [rng.choice("abcdefgh") * rng.randint(0, 9) for _ in range(15)]
        ids, sizes = store.ids(words, np.array([15]))
        assert ids.tolist() == [ord(c) for w in words for c in w] and sizes.tolist() == [len(ids)]


def test_char_ngrams_depend_on_the_word_alone():
    one, n1 = char_ngrams(["abc"], 1, 4, 20)
    two, n2 = char_ngrams(["x", "abc", "abcd"], 1, 4, 20)
    assert two[n2[0] : n2[0] + n2[1]].tolist() == one.tolist() and n2[1] == n1[0] == 5 + 4 + 3 + 2 + 1


def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_token_ids_equal_the_tokenizer():
    coder, oracle = packing.TokenIds(packing.tokenizer_path(), limit=40), _tokenizer()
    texts = [*ODD, "don't I'LL x²y ﬁ Å İstanbul a.b, c.,d .. Éé,", "x\x1cy <|endoftext|> z", *[t or "" for _, t in DOCS], *[prose(i, 40) for i in range(10)]]
    for at in range(0, len(texts), 3):
        ids, sizes = coder.encode(texts[at : at + 3])
        assert ids.tolist() == [i for t in texts[at : at + 3] for i in oracle.encode(t, add_special_tokens=False).ids]
        assert sizes.sum() == len(ids)


def test_packing(spark):
    oracle = _tokenizer()
    rows = [r for r in DOCS if r[0] not in (None, 10)] + [(200 + i, prose(i, 20 + i * 7)) for i in range(60)]
    got = packing.pack(docs(spark, rows), packing.tokenizer_path()).collect()
    ids = {i: np.array([*oracle.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    assert {r["doc_id"] for r in got} == set(ids)
    places, sums = {}, {}
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        sums.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, cuts in sums.items():
        end = 0
        for start, length in sorted(cuts):
            assert start == end
            end += length
        assert end == len(ids[i])
    total = 0
    for cuts in places.values():
        end = 0
        for offset, length in sorted(cuts):
            assert offset == end
            end += length
        assert end <= 2048
        total += end
    assert len(places) <= total / 2048 * 1.03 + 2


def test_packing_repeated_rows_and_empty(spark):
    got = packing.pack(docs(spark, [(10, "one two")] * 3), packing.tokenizer_path()).collect()
    assert len(got) == 3 and len({(r["sequence_id"], r["offset"]) for r in got}) == 3
    assert packing.pack(docs(spark, []), packing.tokenizer_path()).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_the_demand_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    demand = np.zeros(64, np.int64)
    np.add.at(demand, rng.integers(0, 64, 3000), 1)
    patterns, times = packing.plan_sequences(demand)
    assert (times @ patterns == demand).all() and (patterns @ np.arange(1, 65) <= 64).all()
    lower = demand @ np.arange(1, 65) / 64
    relaxed = packing.solve_patterns(demand)[1].sum()
    assert lower - 1e-6 <= relaxed <= times.sum() + 1e-6 <= max(lower, relaxed) * 1.02 + 3
    assert packing.plan_sequences(np.zeros(8, np.int64))[0].shape == (0, 8)


def test_simplex_on_a_known_case():
    demand = np.array([0, 0, 20, 0, 18, 0, 0, 0, 0, 0])  # pieces of 3 and 5 in 10: 9 pairs of fives, threes by three
    assert packing.solve_patterns(demand)[1].sum() == pytest.approx(9 + 20 / 3)


@pytest.mark.parametrize("root", [2, 3, 8])
@pytest.mark.parametrize("size", [0, 1, 2, 5, 4000, 60_000])
def test_lzw_round_trip(root, size):
    rng = np.random.default_rng(size)
    for data in (rng.integers(0, 1 << root, size, dtype=np.uint8).tobytes(), bytes(size)):
        assert gif.lzw_decode(gif.lzw_encode(data, root), root, size) == data


def _plain_lzw(codes, root):
    """Samples of a list of codes by the textbook's table, None for an unknown code."""
    clear, out, table, before = 1 << root, b"", [], b""
    for c in codes:
        if c == clear:
            table, before = [bytes([i]) for i in range(clear)] + [b"", b""], b""
        elif c == clear + 1:
            break
        elif c > len(table) or (c == len(table) and not before) or (not before and c > clear):
            return None
        else:
            entry = table[c] if c < len(table) else before + before[:1]
            if before and len(table) < 4096:
                table.append(before + entry[:1])
            out, before = out + entry, entry
    return out


def test_lzw_of_any_codes_and_of_full_tables():
    rng, root, clear = random.Random(5), 2, 4
    widths = gif._schedule(root)[0].tolist() + [12] * 1_000
    for n in [3, 20, 60] * 30 + [9000]:  # the last one goes on with a full table for long
        codes = [clear]
        for j in range(n):
            codes.append(rng.choice([rng.randrange(4), rng.randrange(4), min(5 + j, 4095)]) if j else 1)
        codes.append(clear + 1)
        bits = "".join(f"{c:0{w}b}"[::-1] for c, w in zip(codes, [root + 1, *widths], strict=False))
        bits += "0" * (-len(bits) % 8)
        stream = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        expected = _plain_lzw(codes, root)
        if expected is None:
            with pytest.raises(ValueError):
                gif.lzw_decode(stream, root, 1 << 20)
        else:
            assert gif.lzw_decode(stream, root, len(expected)) == expected


def test_lzw_known_stream_and_errors():
    # clear, 1, 6 (a code that names itself), 6, 2, end, in three bits: the well-known first bytes of a GIF
    assert gif.lzw_decode(bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01]), 2, 100)[:10] == bytes([1, 1, 1, 1, 1, 2, 2, 2, 2, 2])
    for bad in (b"", b"\xff\xff", gif.lzw_encode(b"\x01\x02", 2)):
        with pytest.raises(ValueError):
            gif.lzw_decode(bad, 2, 50)


def test_disposal_transparency_palettes_interlace():
    red_blue = np.array([[255, 0, 0], [0, 0, 255], [0, 255, 0], [9, 9, 9]], np.uint8)
    local = np.array([[1, 2, 3], [4, 5, 6]], np.uint8)
    whole, part = np.zeros((9, 5), np.uint8), np.ones((2, 2), np.uint8)
    striped = np.repeat(np.arange(9, dtype=np.uint8)[:, None] % 4, 5, axis=1)
    frames = [
        gif.Frame(whole, delay=5),
        gif.Frame(part, 1, 1, 7, gif.TO_PREVIOUS),
        gif.Frame(np.array([[1, 2], [2, 1]], np.uint8), 3, 0, 0, gif.TO_BACKGROUND, transparent=2),
        gif.Frame(np.array([[1]], np.uint8), 4, 8, 1, gif.KEEP, palette=local),
        gif.Frame(striped, interlaced=True),
    ]
    shown = [c for _, c in gif.decode_gif(gif.encode_gif(frames, red_blue))]
    red = (255, 0, 0, 255)
    assert [len(shown), tuple(shown[0][8, 4])] == [5, red]
    assert tuple(shown[1][1, 1]) == (0, 0, 255, 255) and tuple(shown[2][1, 1]) == red
    assert tuple(shown[2][0, 3]) == (0, 0, 255, 255) and tuple(shown[2][0, 4]) == red
    assert tuple(shown[3][0, 3]) == (0, 0, 0, 0) and tuple(shown[3][8, 4]) == (4, 5, 6, 255)
    assert (shown[4][:, 0, :3] == red_blue[np.arange(9) % 4]).all()
    assert gif.histogram(shown[3]).sum() == 45 - 4


def test_gif_frames(spark):
    got = {r["doc_id"]: r for r in gif.read_payloads(gif.store_texts(docs(spark))).collect()}
    for i, t in DOCS:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert sum(map(int, r["feature"].split(","))) == len(payload)
    assert got[9]["media_sha256"] == got[10]["media_sha256"]
    frames = gif.read_frames(gif.store_texts(docs(spark)).where("doc_id = 8")).orderBy("frame").collect()
    assert len(frames) > 1 and [f["shown_at_ms"] for f in frames] == [100 * k for k in range(len(frames))]
    broken = spark.createDataFrame([(1, b"GIF89a"), (2, None), (3, b"no")], "doc_id long, media binary")
    assert all(r["error"] and r["frame"] is None for r in gif.read_frames(broken).collect())
    assert gif.read_payloads(gif.store_texts(docs(spark, []))).collect() == []


def _brute_licenses(text):
    words, out = licenses.words_of(text), []
    for name, template in licenses.TEMPLATES.items():
        t = licenses.words_of(template)
        size = min(5, len(t))
        want = {tuple(t[i : i + size]) for i in range(len(t) - size + 1)}
        have = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        if len(want & have) / len(want) >= 0.8:
            out.append(name)
    return sorted(out)


def test_licenses(spark):
    header = licenses.TEMPLATES["Apache-2.0-header"]
    changed = " ".join(w if i % 60 else "changed" for i, w in enumerate(header.split()))
    texts = ["", "no licence here", "x " * 500 + "Released under the MIT License." + " y" * 500, prose(1, 900) + " " + header + " " + prose(2, 900), prose(3, 77) + " " + changed, licenses.TEMPLATES["GPL-3.0-header"].upper(), header[: len(header) // 2]]
    texts += [prose(i, 100 + i) + " " + licenses.TEMPLATES["MIT-text"] for i in range(0, 60, 7)]
    rows = list(enumerate(texts)) + [(100, None)]
    got = {}
    for r in licenses.scan_licenses(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
        assert 0.8 <= r["containment"] <= 1 and r["start"] < r["end"]
    assert {i: sorted(v) for i, v in got.items()} == {i: b for i, t in enumerate(texts) if (b := _brute_licenses(t))}
    assert licenses.scan_licenses(docs(spark, [])).collect() == []


def test_every_stretch_of_a_license_is_told(spark):
    notice, other = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["ISC"]
    text = f"\u0130stanbul {notice}. " + prose(1, 400) + f" {notice.upper()} {notice}\n" + prose(2, 90) + " " + other
    got = [(r["license"], text[r["start"] : r["end"]].lower()) for r in licenses.scan_licenses(docs(spark, [(1, text)])).collect()]
    words = lambda t: " ".join(licenses.words_of(t))
    assert sorted((n, words(t)) for n, t in got) == [("ISC", words(other))] + [("MIT", words(notice))] * 3


def test_license_templates_are_looked_up():
    """A thousand templates, of which each text holds one."""
    scanner = licenses.Scanner({f"t{i}": prose(i, 12 + i % 70) for i in range(1000)})
    cache = WordCache(licenses._word_hashes)
    texts = [prose(5000 + i, 60) + " " + prose(i, 12 + i % 70) + " " + prose(7000 + i, 60) for i in range(0, 1000, 50)]
    assert [{h[0] for h in hits} for hits in scanner.scan(texts, cache)] == [{f"t{i}"} for i in range(0, 1000, 50)]


def test_huge_gif_screens_are_errors(spark):
    small = gif.encode_gif([gif.Frame(np.zeros((2, 2), np.uint8))])
    bomb = small[:6] + b"\xff\xff\xff\xff" + small[10:]
    media = spark.createDataFrame([(1, bytearray(bomb)), (2, bytearray(small)), (3, None)], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in gif.read_frames(media).collect()}
    assert "65535 x 65535" in got[1]["error"] and got[2]["error"] is None and got[2]["width"] == 2 and got[3]["error"] == "no file"


def test_other_normalisers_are_refused():
    pieces._check_normaliser(pieces.normalise)
    with pytest.raises(ValueError, match="normaliser"):
        pieces._check_normaliser(lambda t: pieces.normalise(t).replace("\ufb01", "fi"))


def test_packing_numbers_full_pieces_once(spark):
    rows = [(i, " ".join(["word"] * (3_000 + 500 * i))) for i in range(12)]
    got = packing.pack(docs(spark, rows), packing.tokenizer_path()).collect()
    full = [r["sequence_id"] for r in got if r["length"] == 2048]
    assert len(full) == len(set(full)) >= 12 and not set(full) & {r["sequence_id"] for r in got if r["length"] < 2048}
    assert all(r["offset"] == 0 for r in got if r["length"] == 2048)
