"""Parts of the corpus operators against brute force, without Spark."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash

from tallystream.llm import audio_media, decontaminate, html_extract, simhash, suffix_dedup, toxicity


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_array_and_prefixes(letters):
    rng = random.Random(letters)
    for n in (1, 2, 3, 7, 60, 700):
        d = np.array([97 + rng.randrange(letters) for _ in range(n)], np.uint8)
        d = np.r_[d, d[: n // 2], d]
        b = d.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        sa = suffix_dedup.suffix_array(d)
        assert sa.tolist() == want
        got = suffix_dedup.common_prefixes(d, sa)
        for j in range(1, len(want)):
            x, y = b[want[j] :], b[want[j - 1] :]
            assert got[j] == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_fingerprint():
    for t in ("", "A b", "a b c d", "The the the the the x y z " * 90):
        w = t.encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_vantage_tree_joins_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) for _ in range(4)])
    fp = np.unique(np.concatenate([base, near, near[:200] ^ np.uint64(0b1110)]))
    d = simhash.distance(fp[:, None], fp[None, :]) <= 4
    a, b = np.nonzero(d & (np.arange(len(fp))[:, None] != np.arange(len(fp))[None, :]))
    want = simhash.local_components(len(fp), a, b)
    assert (simhash.local_components(len(fp), *simhash.VantageTree(fp, leaf=8).links(4)) == want).all()
    # every link lies in a shard of some family
    for m in (5, 6, 7):
        masks = [np.uint64(x) for x in simhash.part_masks(m)]
        assert all(any((fp[i] ^ fp[j]) & k == 0 for k in masks) for i, j in list(zip(a, b))[:500])


def test_audio_round_trip_and_damage():
    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 1000, 5000):
        p = audio_media.padded(rng.randbytes(n))
        x = audio_media.decode(audio_media.encode(p))
        assert x["payload"] == p and x["agrees"] and not x["bad"] and not x["skipped"] and x["samples"] == 1152 * x["frames"] == 1152 * x["table"]["frames"]
    m = bytearray(audio_media.encode(bytes(5000)))
    where = audio_media.decode(bytes(m))["offsets"]
    m[where[1] + 8] ^= 1  # side information: the checksum fails
    x = audio_media.decode(bytes(m[: where[2]]) + b"junk" + bytes(m[where[2] :]))
    assert x["bad"] == 1 and x["skipped"] == 4 and len(x["offsets"]) == len(where)
    assert audio_media.decode(b"")["frames"] == audio_media.decode(b"\xff\xfb")["frames"] == 0


def test_crc16():
    assert audio_media.crc16(b"123456789") == 0xAEE7
    assert struct.pack(">I", zlib.crc32(b"")) == bytes(4)


def test_html_blocks_and_field():
    page = "<div><p>a &lt; b<br>c<script>x</script><b>d</b>e<p>  <a href=x>l i n k</a></div>tail<!-- no -->"
    assert [(b[0], b[2]) for b in html_extract.leaf_blocks(page)] == [("a < b cde", 0), ("l i n k", 7), ("tail", 0)]
    assert html_extract.leaf_blocks("") == [] and html_extract.leaf_blocks("<<<>&#x;<script>never closed") is not None
    field, rng, exact = html_extract.default_field(), random.Random(77), 0
    for _ in range(60):
        p, content = html_extract.labelled_page(rng)
        exact += field.main_text(p) == "\n\n".join(content)
    assert exact >= 54
    assert field.main_text("") == "" and field.main_text("<nav><a href=/>x</a></nav>") == ""


def test_html_layouts_that_training_does_not_make():
    long = "Sorel mitadu kanofe, rilota benu damisa poretu lakine sofira. Temo ladi pasoru nemika, tolade firune basemo."
    noise = [
        f"<div class='cookieBanner'><p>{long}</p><button>OK</button></div>", f"<div id='gdpr-bar'>{long}</div>", f"<dialog open><p>{long}</p></dialog>", f"<div class='ad-slot'>{long}</div>",
        f"<div class='sponsored-content'><p>{long}</p></div>", f"<div id='sidebarRight'><h3>More</h3><p>{long}</p></div>", f"<aside><p>{long}</p></aside>",
        f"<ol class='comment-list'><li><article><p>{long}</p></article></li></ol>", f"<section class='userComments'><p>{long}</p></section>",
        "<section class='related-posts'><h2>Read also</h2><ul><li><a href=x>One more story</a></li><li><a href=x>Two more</a></li></ul></section>",
        "<form action=x><p>Join our letter and get all the news each week in your box.</p><input><button>Go</button></form>", "<div class='breadcrumbs'><a href=/>Home</a> / <a href=/x>News</a> / Item</div>",
        "<div role='navigation'><ul><li><a href=/>Home</a></li><li><a href=/>About</a></li></ul></div>", f"<div role='complementary'><p>{long}</p></div>", f"<footer class='site-footer'><p>{long}</p></footer>",
        f"<noscript>{long}</noscript>", f"<div hidden><p>{long}</p></div>", f"<div style='display:none'><p>{long}</p></div>", f"<p class='notice'>{long}</p>", "<ul class='share-buttons'><li>Send this</li><li>Print this</li></ul>",
    ]
    inner = f"<h1>The title</h1><p>{long}</p><p>Short one.</p>%s<p>{long} {long}</p>"
    want = "\n\n".join(["The title", long, "Short one.", f"{long} {long}"])
    field, good, all_ = html_extract.default_field(), 0, 0
    for body in (f"<article>{inner}</article>", f"<main>{inner}</main>", f"<div class='entry-content'>{inner}</div>", f"<div id=post-12>{inner}</div>", f"<div class=postBody>{inner}</div>", f"<div>{inner}</div>"):
        for n in noise:
            for page in (body % n, n + body % "", body % "" + n):
                page = f"<html><head><title>T</title></head><body><header><a href=/>Logo</a></header>{page}<footer>&copy; 2020 Us</footer></body></html>"
                good, all_ = good + (field.main_text(page) == want), all_ + 1
    assert good >= 0.97 * all_, (good, all_)
    assert field.main_text(f"<article>{long}<br><br>{long}</article>") == f"{long} {long}"


def test_template_words():
    c = decontaminate.canonical
    assert c("(1,200)")[0] == "<num>" and c("km.")[0] == "<unit>" and c("5km")[0] == "<num><unit>" and c("Anna's")[:2] == ("<name>", "anna's") and c("--")[0] == "--" and c("...") == ("", "", "")


def test_toxicity_model():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(400):
        w = [word() for _ in range(80)]
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(80)] = rng.choice(["blorkish", "grumpfen", "zwackel"])
        rows.append((" ".join(w), int(i % 4 == 0)))
    m = toxicity.fit(rows[:300])
    hits = [(m.score(t) >= 0.7) == bool(y) for t, y in rows[300:]]
    assert sum(hits) >= 95 and 0 <= m.score("") <= 1
    assert toxicity.fit([]).score("x") == 0.0 and toxicity.fit(rows[1:4]).score("x") == 0.0


def test_toxicity_drops_only_near_copies_of_one_label():
    rng = random.Random(5)
    many = [(f"a b c d e f g h {' '.join(f'z{rng.randrange(9000)}' for _ in range(40))}", i % 2) for i in range(150)]
    assert toxicity.distinct(many) == many  # common words are no copies
    base = " ".join(f"w{i}" for i in range(100))
    near, other = base.replace("w50 ", "x "), base.replace("w20 ", "x ").replace("w50 ", "x ").replace("w80 ", "x ")
    rows = [(base, 0), *many, (base, 0), (near, 0), (near, 1), (other, 0), ("", 0), ("", 0), ("", 1), ("one two", 1), ("one two", 1)]
    assert toxicity.distinct(rows) == [(base, 0), *many, (near, 1), (other, 0), ("", 0), ("", 1), ("one two", 1)]
    for _ in range(20):  # against every pair
        rows = [(" ".join(rng.choice("abc") for _ in range(rng.randrange(3, 14))), rng.randrange(2)) for _ in range(60)]
        want, sets = [], []
        for t, y in rows:
            w = t.split()
            s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
            if not any(y == z and len(s & o) * 5 >= len(s | o) * 4 for o, z in sets):
                want.append((t, y))
                sets.append((s, y))
        assert toxicity.distinct(rows) == want


def test_toxicity_dictionaries_learn_from_whole_texts(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "_dictionary", lambda samples, size, segment: seen.append(samples) or b"x")
    texts = [" ".join(f"d{i}w{k}" for k in range(750)) for i in range(4)]
    toxic = [f"blorkish t{i} " + " ".join(f"t{i}w{k}" for k in range(750)) for i in range(4)]
    toxicity.dictionaries(toxic, texts)
    offered = lambda n: sorted(w for s in seen[n] for w in s.split())
    assert offered(0) == sorted(w.encode() for t in texts for w in t.split()) and offered(1) == sorted(w.encode() for t in toxic for w in t.split())


def test_toxicity_margins_and_score_by_hand():
    import zstandard as zs

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8)))
    rows = [(" ".join([*(word() for _ in range(60)), *(["blorkish", "grumpfen"] * (i % 3 == 0))]), int(i % 3 == 0)) for i in range(90)]
    m = toxicity.fit(rows)
    params = zs.ZstdCompressionParameters.from_level(9, window_log=20, hash_log=16, chain_log=16, min_match=4, strategy=zs.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS)
    length = lambda d, x: len(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d + toxicity.ANCHOR, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params).compress(x + toxicity.ANCHOR))
    for text in ("", " , ", "Blorkish", "a (Grumpfen), the end " * 5, rows[0][0], rows[1][0], "One\ttwo\nthree"):
        w = [x.strip(".,;:!?()[]{}\"'*$%#&|") for x in text.lower().split()]
        w = [x.encode() for x in w if x]
        x = []
        for ahead in (lambda c, n: math.log1p(c), lambda c, n: c * 50 / (n + 50)):
            for width in (1, 4):
                each = [b" " + b" ".join(w[i : i + width]) + b" " for i in range(0, len(w), width)]
                margin = [length(m.ordinary, y) - length(m.toxic, y) for y in each]
                x += [ahead(sum(v >= k for v in margin), len(each)) for k in range(9)]
        x += [math.log1p(len(w)), 1.0]
        assert abs(m.score(text) - 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, m.weights))))) < 1e-9
    assert m.score("blorkish grumpfen " + word()) > m.score(word() + " " + word())


def test_toxicity_pieces():
    text = "one two  three " * 50 + "x" * 90 + " end"
    for size in (1, 7, 64, 10**6):
        got = list(toxicity.pieces(text, size))
        assert [w for p in got for w in p] == toxicity.words(text) and all(len(p) % 4 == 0 for p in got[:-1])
    assert list(toxicity.pieces("")) == list(toxicity.pieces(" . ")) == []
