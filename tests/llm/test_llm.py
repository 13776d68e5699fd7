"""The ten operators on small fixtures: brute force, round trips, and defined cases."""

import base64
import hashlib
import io
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash
from pyspark.sql import functions as F

from vacancia.llm import common, decontaminate, jpeg, line_dedup, packing, pst, quality, simhash, substring_dedup, token_rollup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, key string, place string, found string, status string"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), "n", "k", "p", "f", "x") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rnd.choice(words) for _ in range(40))
    out = []
    for i in range(60):
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 12))) for _ in range(rnd.randint(1, 9))]
        if i % 4 == 0:
            lines.insert(len(lines) // 2, passage)
        if i % 5 == 0:
            lines += ["same one line", "same two line", "same three line", "same four line"]
        out.append("\n".join(lines))
    out += [out[3], out[3], out[3] + " tail", "", None, "a", "a a a a a a a a a a a a a a a a a a", "x\n\n \ny", "Ünï cödé"]
    return out


def component_of(prints, radius=2):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_simhash_against_all_pairs(spark, texts, one_task, monkeypatch):
    monkeypatch.setattr(common, "ONE_TASK", one_task)  # beyond it hot keys are joined by broadcast
    texts = [*texts, *[texts[7]] * 20]
    prints = {}
    for i, t in enumerate(texts):
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        values = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))
    want = component_of(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_bit_slices_find_every_close_pair():
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(40)]
    values = np.array(sorted({b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(5)} | set(base)), dtype=np.uint64)
    a, b = simhash.close_lanes(values, np.zeros(len(values), dtype=np.int64))
    want = {(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (int(values[i]) ^ int(values[j])).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_substrings_against_all_windows(spark, texts):
    first, words = {}, [(t or "").encode().split() for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = {}
    for i, w in enumerate(words):
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, texts)).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 100


def test_long_passages_against_all_windows(spark):
    rnd = random.Random(8)
    words = [f"v{i}" for i in range(900)]
    passage = [rnd.choice(words) for _ in range(400)]
    docs = []
    for i in range(40):
        w = [rnd.choice(words) for _ in range(rnd.randint(0, 150))]
        if i % 3 == 0:
            a = rnd.randrange(300)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + rnd.randint(13, 100)]
        docs.append(w)
    docs += [passage, passage, passage[:200] + ["x"] + passage[200:], ["r"] * 70, ["r"] * 50 + ["s"], ["t", "u"] * 60]
    first = {}
    for i, w in enumerate(docs):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = {}
    for i, w in enumerate(docs):
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    table = frame(spark, [" ".join(w) for w in docs])
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(table).collect()} == want
    rows = substring_dedup.named(table, 4)
    assert substring_dedup.long_repeats(rows).count() > 5
    clash = rows.where("doc_id is not null").withColumn("name", F.lit(7).cast("long"))
    assert substring_dedup.long_repeats(substring_dedup.written(clash, "clash")).count() == substring_dedup.long_repeats(rows).count()


def test_one_name_for_all_windows(spark):
    """A name that spans pieces, and whose windows differ, is judged by the windows."""
    rnd = random.Random(4)
    rows, want, least = [], set(), {}
    content = {d: [rnd.randrange(60) for _ in range(rnd.randint(1, 6))] for d in range(80)}
    for d, hashes in content.items():
        for h in hashes:
            least[h] = min(d, least.get(h, d))
    for d, hashes in content.items():
        rows.append((7, d, (5 << 32) | 100, 0, b"".join(h.to_bytes(substring_dedup.HASH_BYTES, "little") for h in hashes)))
        want |= {(d, j) for k, h in enumerate(hashes) if least[h] < d for j in range(100 + k, 113 + k)}
    rows.append((8, 3, (5 << 32) | 500, 20, b""))
    want |= {(3, j) for j in range(500, 520)}
    filed = spark.createDataFrame(rows, "name long, doc_id long, place long, known int, hashes binary").repartition(3)
    got = substring_dedup.repeated_spans(filed, partitions=2, piece=7).collect()
    assert {(r.doc_id, j) for r in got for j in range(r.begin, r.end)} == want and {r.text_hash for r in got} == {5}


def test_lines_against_all_windows(spark, texts):
    long = "one long line that stands alone in two documents, far from any other"
    pieces = [["p q", "r s", "t u"], ["u v", "r s", "t u", "x y"], ["p q", "r s", "z z"], ["u v", "r s", "t u"], ["r s", "t u", "x y"], [long], ["b c", long, long], ["r s", "t u"]]
    texts = [*texts, *("\n".join(p) for p in pieces), "r s\nt u\n" * 3000]
    first, lines, one = {}, [], {}
    for i, t in enumerate(texts):
        own = [(n, x) for n, x in enumerate((t or "").split("\n")) if x.strip()]
        lines.append(own)
        for k in range(len(own) - 2):
            first.setdefault(tuple(x for _, x in own[k : k + 3]), (i, k))
        for k, (_, x) in enumerate(own):
            one.setdefault(x, (i, k))
    want = {}
    for i, (t, own) in enumerate(zip(texts, lines, strict=True)):
        gone = {own[k + d][0] for k in range(len(own) - 2) if first[tuple(x for _, x in own[k : k + 3])] < (i, k) for d in range(3)}
        gone |= {n for k, (n, x) in enumerate(own) if len(x.encode()) >= 40 and one[x] < (i, k)}
        want[i] = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
    done = line_dedup.remove_repeats(frame(spark, texts))
    rows = done.collect()
    few = line_dedup.remove_repeats(frame(spark, texts).select("doc_id", "text", F.lit("mine").alias("FOUND"), F.lit("own").alias("n_lines"), F.lit(1).alias("first"))).collect()
    assert {r.doc_id: (r.text, r.FOUND, r.n_lines, r.first, r.n_removed) for r in few} == {r.doc_id: (r.text, "mine", "own", 1, r.n_removed) for r in rows}
    assert {r.doc_id: r.text for r in rows} == want and sum(r.n_removed for r in rows) > 20
    assert [c for c in SCHEMA.replace(",", "").split() if c not in ("long", "string")] == done.columns[:-2]


def test_packing_covers_all_and_fits(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [*texts, "two  spaces", " lead", "trail ", "a \n b", "x<|endoftext|>y", "tab\t tab", "n\n \n m", "word " * 900]
    want = set()
    for i, t in enumerate(odd):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        count = -(-len(ids) // 64)
        cuts = [0, *(len(ids) - 64 * k for k in range(count - 1, -1, -1))]
        want |= {(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    rows = packing.pack(frame(spark, odd), capacity=64, with_ids=True).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id] and len(r.ids) == 4 * r.length
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 64


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_near_the_bound(seed):
    rnd = random.Random(seed)
    histogram = Counter(rnd.choice((rnd.randint(1, 1024), rnd.randint(1, 200))) for _ in range(3000))
    patterns = packing.plan(histogram)
    placed = Counter()
    for p in patterns:
        assert p.filled <= 1024 and sum(n for length, n in p.items if 3 * length > 1024) <= 2
        for length, n in p.items:
            placed[length] += n * p.bins
    assert placed == histogram
    bound = max(-(-sum(k * n for k, n in histogram.items()) // 1024), sum(n for k, n in histogram.items() if k > 512))
    assert sum(p.bins for p in patterns) <= 1.02 * bound + 1


ITEM = "Alice buys 12 pounds of small red apples for 30 dollars and then gives away half of them to her younger brother before noon"
OTHER = "The station near Paris was closed after Monday because heavy rain flooded both tunnels under the old town bridge"


@pytest.mark.parametrize(
    ("text", "leaks"),
    [
        (f"intro words here. {ITEM}. outro", True),
        ("noise before. Bob buys 7 pounds of small red apples for 95 euros and then gives away half of them to her younger brother before noon", True),
        (f"noise {ITEM.upper()} noise", True),
        ("Alice buys 12 pounds of small red apples for the party of the year", False),
        ("12 30 40 50 60 70 80 90 11 22 33 44 55 66", False),
        ("", False),
        (None, False),
    ],
)
def test_templates(spark, text, leaks):
    pytest.importorskip("pyarrow")
    items = [(1, ITEM), (2, OTHER), (3, ITEM), (4, None), (None, ITEM), (5, "")]
    got = decontaminate.judged  # the join's judge, on windows made here
    lexicon = decontaminate.Lexicon()
    make = lambda t: decontaminate.canonical([(t or "").encode()], lexicon)
    bench = {}
    for i, t in items:
        if i is not None:
            s = make(t)
            starts, hashes = decontaminate.templates(s, 8, 5)
            for a, k, slots in zip(starts.tolist(), *decontaminate.keyed(s, starts, hashes, 8), strict=True):
                bench.setdefault(int(k), {"item_id": i, "item_place": a, "item_slots": slots, "size": len(s.code)})
    s = make(text)
    starts, hashes = decontaminate.templates(s, 8, 5)
    pairs = [{**bench[int(k)], "place": a, "slots": slots, "width": 8} for a, k, slots in zip(starts.tolist(), *decontaminate.keyed(s, starts, hashes, 8), strict=True) if int(k) in bench]
    assert bool(got(pairs, 12)) == leaks


def test_contaminated_documents(spark):
    changed = ITEM.replace("12", "7").replace("30", "95").replace("Alice", "Bob")
    inconsistent = "Tom paid 5 coins to Ann and then 5 more coins to Ann"
    items = spark.createDataFrame([(1, ITEM, "k"), (2, OTHER, "k"), (3, ITEM, "k"), (4, None, "k"), (None, ITEM, "k"), (5, inconsistent, "k")], "item_id long, text string, key string")
    docs = frame(spark, [f"x y. {ITEM}. z", f"so {changed} so", "clean words only " * 20, None, "", OTHER, "Tom paid 5 coins to Ann and then 6 more coins to Ann"], [10, 11, 12, 13, 14, 15, 16])
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(docs, items).collect()}
    assert {d for d, _ in got} == {10, 11, 15} and got[10, 1] is False and got[11, 1] is True
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0


def test_every_item_of_a_window_is_judged(spark):
    short = "plain words of one short item that stand"
    long = f"{short} also in a longer one of smaller id and go on"
    a = "Give 5 red coins to each of the old men by the river and keep 5 blue coins for the young men"
    b = a.replace("keep 5", "keep 9")
    items = spark.createDataFrame([(1, long), (2, short), (3, a), (4, b)], "item_id long, text string")
    docs = frame(spark, [f"x y. {short}. z", f"so {b} so", f"so {a} so", "clean words only"], [10, 11, 12, 13])
    got = {(r.doc_id, r.item_id): (r.n_symbols, r.reparameterised) for r in decontaminate.contaminated(docs, items).collect()}
    assert got[10, 2] == (8, False) and (10, 1) not in got
    assert got[11, 4] == (21, False) and got[12, 3] == (21, False)
    assert {d for d, _ in got} == {10, 11, 12}


def test_items_of_few_literal_words(spark):
    train = "A train travels 60 miles in 2 hours and then 90 miles in 3 hours"
    items = [(1, train), (2, "What is 12 plus 7?"), (3, "Is it so"), (4, "3 4 5 6 7 8 9 10 11 12 13 14 15"), (5, "Add 2 and 9 to 4 but not to 8 nor 6 kg in 2 h")]
    texts = [f"we say: {train}. End", f"we say: {train.replace('60', '70').replace('90', '85')}. End", "and what is 12 plus 7 now", "and what is 12 plus 8 now", "who is it so far", f"x {items[3][1]} y", "x 3 4 5 6 7 8 9 10 11 12 99 14 15 y", items[4][1], "clean words only"]
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 1): False, (1, 1): True, (2, 2): False, (4, 3): False, (5, 4): False, (7, 5): False}


def test_windows_against_brute_force():
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["7", "8", "kg", "pears", "figs", "and", "or"]) for _ in range(rnd.randint(0, 30))).encode() for _ in range(40)]
    s = decontaminate.canonical(texts, decontaminate.Lexicon())
    found = set(zip(*(x.tolist() for x in decontaminate.windows(s, 8, 5)), strict=True))
    kinds, rows, wanted, of = s.kind.tolist(), s.row.tolist(), set(), {}
    for a in range(len(kinds)):
        here = [k for k in range(a, len(kinds)) if rows[k] == rows[a]]
        if len(here) >= 8:
            literal = [k for k in here if not kinds[k]]
            wanted.add((a, 8))
            if len(literal) >= 5:
                wanted.add((a, max(8, literal[4] - a + 1)))
    assert {(a, w) for a, _, w in found} == wanted and len(found) == len(wanted)
    for a, h, w in found:
        enough = kinds[a : a + w].count(0) >= 5
        of.setdefault((enough, w, tuple((s.code if enough else s.value)[a : a + w].tolist())), set()).add(h)
    assert all(len(h) == 1 for h in of.values()) and len(set().union(*of.values())) == len(of)


def test_warc_round_trip(spark):
    rows = [(5, "http://www.B.example/x?q=1", "<p>same</p>", "k"), (3, "https://b.example:8080/", "<p>same</p>", "k"), (4, None, "", "k"), (9, "http://a.example/\r\nX: y", None, "k"), (7, "http://a.example/", "é" * 5000, "k"), (8, "http://a.example/", "u", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string").repartition(2)
    captures = warc.write(pages)
    found = warc.lookup(warc.index(captures, block=2, partitions=3), captures)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in warc.read(found, with_payload=True).collect()}
    want = {}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        first = min(k for k, _, h, _ in rows if (h or "") == (html or ""))
        want[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first == i else "revisit", None if first == i else first, data if first == i else b"")
    assert got == want
    one = warc.lookup(warc.index(captures, block=2, partitions=3), spark.createDataFrame([("example,a)/",), ("none",)], "key string"))
    assert sorted(r.page_id for r in one.collect()) == [7, 8]
    assert warc.archive(pages.limit(0)).count() == 0
    many = warc.lookup(warc.index(captures, block=1, partitions=2), captures, group_keys=1)
    assert sorted((r.key, r.page_id) for r in many.collect()) == sorted((r.key, r.page_id) for r in captures.collect())
    odd = spark.createDataFrame([(None, "http://x.example/", "one"), (2, "http://x.example/", "one"), (2, "http://x.example/", "one"), (3, None, "z" * 300_000)], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archive(odd).collect()) == [("2", "response", None)] * 2 + [("3", "response", None), ("None", "revisit", 2)]
    assert warc.url_key("https://user@WWW.Example.com:443/A?b#c") == "com,example)/A?b"


def test_media_round_trip(spark, texts):
    rows = jpeg.features(jpeg.store(frame(spark, texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        padded = data + b" " * (192 - len(data) % 192 if len(data) % 192 or not data else 0)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.feature) == r.feature


def test_media_is_a_jpeg_that_others_read():
    image = pytest.importorskip("PIL.Image")
    data = bytes(range(192)) * 4
    picture = image.open(io.BytesIO(jpeg.encode([data])[0]))
    assert picture.mode == "L" and np.asarray(picture)[::8, ::8].tobytes() == data


def colour_jpeg(rng, width, height):
    """A baseline file of three components (4:2:0) with AC coefficients and no restart markers, and its luma DC levels."""
    dc_symbols, ac_symbols = list(range(12)), [0, 0xF0, *(r << 4 | s for r in range(4) for s in range(1, 5))]
    dc = {s: (i, 4) for i, s in enumerate(dc_symbols)}
    ac = {s: (i, 6) for i, s in enumerate(ac_symbols)}
    across, down = -(-width // 16), -(-height // 16)
    bits, previous, luma = [], [0, 0, 0], np.zeros((2 * down, 2 * across), dtype=int)

    def put(value, n):
        bits.append(format(value, f"0{n}b") if n else "")

    def number(value, size):
        put(value if value > 0 else value + (1 << size) - 1, size)

    for m in range(across * down):
        for c, k in [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (2, 0)]:
            level = int(rng.integers(-60, 60))
            diff, previous[c] = level - previous[c], level
            put(*dc[abs(diff).bit_length()])
            number(diff, abs(diff).bit_length())
            at = 1
            while at < 64 and rng.random() < 0.6:
                run, value = int(rng.integers(0, 4)), int(rng.integers(1, 15)) * int(rng.choice([-1, 1]))
                if at + run >= 63:
                    break
                put(*ac[run << 4 | abs(value).bit_length()])
                number(value, abs(value).bit_length())
                at += run + 1
            put(*ac[0])
            if c == 0:
                luma[2 * (m // across) + k // 2, 2 * (m % across) + k % 2] = level
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    scan = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")
    segment = lambda marker, body: bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    table = lambda kind, symbols, n: segment(0xC4, bytes([kind]) + bytes(len(symbols) if k == n else 0 for k in range(1, 17)) + bytes(symbols))
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes([16] * 64)) + segment(0xC0, frame) + table(0, dc_symbols, 4) + table(0x10, ac_symbols, 6)
    return head + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9", luma


def test_colour_with_coefficients_and_broken_files(spark):
    rng = np.random.default_rng(3)
    files = [colour_jpeg(rng, 70, 40), colour_jpeg(rng, 16, 16), colour_jpeg(rng, 33, 90)]
    for (data, luma), (width, height) in zip(files, [(70, 40), (16, 16), (33, 90)], strict=True):
        ((w, h, samples),) = jpeg.thumbnails([data])[0]
        want = np.clip((luma * 16 + 4) // 8 + 128, 0, 255)[: -(-height // 8), : -(-width // 8)]
        assert (w, h) == (width, height) and (samples == want).all()
    good = jpeg.encode([b"x" * 192])[0]
    rows = [(1, 0, files[0][0]), (2, 0, b"no image"), (3, 0, files[1][0][:-30]), (4, 192, good), (5, 0, None), (6, 0, good[:-2]), (None, 0, good)]
    got = {r.doc_id: r for r in jpeg.features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert {k for k, r in got.items() if r.feature is None} == {2, 3, 5, 6} and got[4].payload_sha256 == hashlib.sha256(b"x" * 192).hexdigest() == got[None].payload_sha256
    assert got[2].media_bytes == 8 and got[5].media_bytes == 0


def test_token_rollup(spark):
    counters = {"words-1": token_rollup.count_words, "chars-1": lambda ts: np.array([len(t) for t in ts])}
    schema = "doc_id long, change string, seq int, text string, source string, lang string, tokens string, sign string"
    rows = lambda *r: spark.createDataFrame([(*x, "c", "c") for x in r], schema)
    first = rows((1, "insert", 1, "a b", "s", "en"), (2, "insert", 1, "c", "s", None), (3, "insert", 1, None, None, "de"), (None, "insert", 1, "z", "s", "en"), (1, "insert", 2, "a b c", "s", "en"))
    second = rows((2, "delete", 1, None, "s", None), (1, "revise", 1, "q", "t", "en"), (9, "delete", 1, None, None, None), (4, "insert", 1, "d e", "s", "en"))
    rollup = token_rollup.Rollup(spark, counters=counters)
    rollup.commit("1", first)
    read = lambda: {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in rollup.totals().collect()}
    assert read() == {("s", "en", "words-1"): (1, 3), ("s", "en", "chars-1"): (1, 5), ("s", None, "words-1"): (1, 1), ("s", None, "chars-1"): (1, 1), (None, "de", "words-1"): (1, 0), (None, "de", "chars-1"): (1, 0)}
    rollup.commit("2", second)
    after = read()
    assert after == {("t", "en", "words-1"): (1, 1), ("t", "en", "chars-1"): (1, 1), ("s", "en", "words-1"): (1, 2), ("s", "en", "chars-1"): (1, 3), (None, "de", "words-1"): (1, 0), (None, "de", "chars-1"): (1, 0)}
    for batch, changes in (("2", second), ("1", first)):
        rollup.commit(batch, changes)
        assert read() == after
    assert {r.doc_id for r in rollup.ledger().collect()} == {1, 3, 4}


def test_token_rollup_over_ten_batches_and_a_restart(spark, tmp_path):
    counters = {"words-1": token_rollup.count_words}
    folder = f"file://{tmp_path}/rollup"
    schema = "doc_id long, change string, seq int, text string, source string, lang string"
    change = lambda i, kind, seq, text: spark.createDataFrame([(i, kind, seq, text, "s", "en")], schema)
    batches = {f"batch-{k}": change(k, "insert", k, "a b") for k in range(1, 10)}
    batches |= {"batch-10": change(2, "revise", 10, "a b c d"), "batch-11": change(2, "revise", 11, "a b c d e"), "batch-12": change(1, "delete", 12, None)}
    rollup = token_rollup.Rollup(spark, folder, counters)
    for name, changes in batches.items():
        rollup.commit(name, changes)
    read = lambda r: [(x.documents, x.tokens) for x in r.totals().collect()]
    assert read(rollup) == [(8, 7 * 2 + 5)]
    again = token_rollup.Rollup(spark, folder, counters)
    assert read(again) == [(8, 19)]
    for name in ("batch-2", "batch-10", "batch-1"):
        again.commit(name, batches[name])
        assert read(again) == [(8, 19)]
    again.commit("batch-13", change(2, "delete", 13, None))
    assert read(token_rollup.Rollup(spark, folder, counters)) == [(7, 14)]
    # Another text under an early name: later batches follow from it, and a failed attempt leaves nothing.
    again.commit("batch-3", change(3, "insert", 3, "a b c d e f g"))
    assert read(again) == [(7, 19)] and read(token_rollup.Rollup(spark, folder, counters)) == [(7, 19)]
    again.commit("batch-1", change(5, "insert", 1, "x"))
    assert read(again) == [(7, 19)]
    with pytest.raises(Exception, match="nowhere"):
        again.commit("batch-14", change(1, "insert", 1, "a").withColumn("text", F.raise_error(F.lit("nowhere")).cast("string")))
    assert read(again) == [(7, 19)] and read(token_rollup.Rollup(spark, folder, counters)) == [(7, 19)]


def test_token_rollup_against_a_dictionary(spark):
    rnd = random.Random(9)
    counters = {"words-1": token_rollup.count_words}
    schema = "doc_id long, change string, seq int, text string, source string, lang string"
    rollup, history = token_rollup.Rollup(spark, counters=counters, ledger_every=3), {}
    assert rollup.totals().count() == 0 and rollup.ledger().count() == 0
    for k in range(7):
        name = f"b{k}" if k != 5 else "b2"
        rows = [(rnd.randrange(12), rnd.choice(["insert", "revise", "delete"]), s, " ".join("w" * rnd.randint(0, 4)), rnd.choice(["s", None]), rnd.choice(["en", "de"])) for s in range(6)]
        history[name] = rows if k != 4 else []
        rollup.commit(name, spark.createDataFrame(history[name], schema))
        state = {}
        for rows in history.values():
            last = {i: (change, text, source, lang) for i, change, _, text, source, lang in rows}
            state |= last
        want = Counter()
        for change, text, source, lang in state.values():
            if change != "delete":
                want[source, lang, 0] += 1
                want[source, lang, 1] += len(text.split())
        got = {(r.source, r.lang): (r.documents, r.tokens) for r in rollup.totals().collect()}
        assert got == {g[:2]: (want[(*g[:2], 0)], want[(*g[:2], 1)]) for g in want}
        assert {r.doc_id for r in rollup.ledger().collect()} == {i for i, s in state.items() if s[0] != "delete"}


def test_suffix_tree_counts_and_scores(spark, texts):
    p = pst.Params(chunk_bytes=2000)
    rows = pst.score(frame(spark, texts), p).collect()
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    count = {n: Counter(tuple(tokens[i][k : k + n]) for i in train for k in range(len(tokens[i]) - n + 1)) for n in (1, 2, 3)}
    total, distinct = sum(count[1].values()), len(count[1])

    def chance(gram):
        if len(gram) == 1:
            return (count[1][gram] + 0.1) / (total + 0.1 * (distinct + 1))
        return (count[len(gram)][gram] + p.mu * chance(gram[1:])) / (count[len(gram) - 1][gram[:-1]] + p.mu)

    states = set()
    for n in (1, 2):
        gain = Counter()
        for gram, c in count[n + 1].items():
            low = chance(gram[1:])
            gain[gram[:-1]] += c * round(256 * np.log((c - 1 + p.mu * low) / (count[n][gram[:-1]] - 1 + p.mu) / low))
        states |= {s for s in gain if count[n][s] >= p.min_count and gain[s] > 256 * p.min_gain}
    assert states and len(rows) == len(texts)
    near = {s for s in states}
    for r in rows:
        t = tokens[r.doc_id]
        best = 0.0
        for k in range(len(t)):
            n = 0
            while n < 2 and k - n - 1 >= 0 and tuple(t[k - n - 1 : k]) in near:
                n += 1
            best += np.log10(chance(tuple(t[k - n : k + 1])))
        base = sum(np.log10(chance((w,))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[1][(w,)] > 0 for w in t), total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(best)
    for size in (600, 1 << 20):
        other = {r.doc_id: r.score for r in pst.score(frame(spark, texts), pst.Params(chunk_bytes=size)).collect()}
        assert all(other[r.doc_id] == pytest.approx(r.score, rel=1e-12) for r in rows)


def test_suffix_tree_counts_beyond_four_bytes():
    keys, amounts = np.array([1 << 63, (1 << 63) + (1 << 40)], dtype=np.uint64), np.array([1 << 33, 5])
    for kind, scale in ((0, 1), (100, -1)):
        batches = [pst.requests(chunk, kind, keys, scale * amounts, 1) for chunk in (0, 1)]
        table = pa.Table.from_batches(batches)
        got = pa.Table.from_batches(list(pst.answers(table.filter(pa.compute.equal(table["target"], 1)), -11))).to_pylist()
        if kind == 0:
            assert [r["total"] for r in got] == [(1 << 34) + 10] * 2 and pst._unpacked(got[0]["sums"]).tolist() == [1 << 34, 10]
        else:
            assert [np.unpackbits(np.frombuffer(r["sums"], dtype=np.uint8))[:2].tolist() for r in got] == [[0, 1]] * 2


def test_quality_learns_and_keeps_its_fold(spark):
    rnd = random.Random(3)
    good, bad = [f"good{i}" for i in range(60)], [f"bad{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(good if i % 2 else bad) for _ in range(30)) for i in range(200)]
    docs = frame(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, i % 2, 0, "k") for i in range(200)] + [(None, 1, 0, "k"), (7, None, 0, "k"), (8, 0, 0, "k")], "doc_id long, quality int, toxic int, text string")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 202 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 200]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(held) > 20
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in held) / len(held) > 0.9
    assert {r.score for r in quality.classify(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_quality_ratios_against_counts(spark):
    rnd = random.Random(6)
    words = [f"k{c}" for c in "abcdefgh"]
    texts = [" ".join(rnd.choice(words[: 5 if i % 2 else 8]) for _ in range(6)) for i in range(60)]
    docs, labels = frame(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    count = {k: Counter() for k in (0, 1)}
    for i in learned:
        w = texts[i].split()
        count[i % 2].update({*w, *zip(w, w[1:], strict=False)})
    total = {k: sum(c.values()) + 2**18 for k, c in count.items()}
    hashes = quality.WordHashes()
    for w in words:
        column = quality.indicators([w.encode()], hashes, 18)[0][0]
        want = np.log((count[1][w] + 1) / total[1]) - np.log((count[0][w] + 1) / total[0])
        assert model.scale[column] == pytest.approx(want)
    rows = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert rows == pytest.approx({i: float(model.scores([t.encode()], hashes)[0]) for i, t in enumerate(texts)})


def test_dual_coordinate_descent_meets_its_conditions():
    rng = np.random.default_rng(1)
    rows = [(np.array([0, 1, 2]), rng.normal(size=3)) for _ in range(80)]
    y = np.array([1.0 if v[0] + 0.3 * v[1] + 0.2 * rng.normal() > 0 else -1.0 for _, v in rows])
    cost = np.full(80, 0.7)
    w, bias = quality.dual_coordinate_descent(rows, y, cost, 3, 2000)
    x = np.array([[*v, 1.0] for _, v in rows])
    full = np.array([*w, bias])
    primal = 0.5 * full @ full + (cost * np.maximum(0, 1 - y * (x @ full))).sum()
    grid = full + rng.normal(scale=0.05, size=(400, 4))
    others = 0.5 * (grid**2).sum(1) + (cost * np.maximum(0, 1 - y * (grid @ x.T))).sum(1)
    assert primal <= others.min() + 1e-6


def test_contamination_against_brute_force(spark):
    rnd = random.Random(12)
    words = ["pears", "figs", "and", "or", "boats", "sail", "north", "slowly", "while", "rain", "falls", "on", "7", "8", "9", "kg", "Ann", "Bob"]
    items = [" ".join(rnd.choice(words) for _ in range(rnd.choice([5, 9, 16, 30]))) for _ in range(12)]
    items[5] = items[4]
    docs = []
    for i in range(40):
        w = [rnd.choice(words) for _ in range(rnd.randint(0, 25))]
        if i % 2:
            part = rnd.choice(items).split()
            if i % 4 == 1:
                part = [{"7": "21", "8": "22", "9": "23"}.get(x, x) for x in part]
            w[len(w) // 2 : len(w) // 2] = part
        docs.append(" ".join(w))
    lexicon = decontaminate.Lexicon()
    read = lambda t: decontaminate.canonical([t.encode()], lexicon)

    def places(s, w, wide):
        """Every window of a text by its content: (key, start, width, slots)."""
        out = []
        kinds, codes, values = s.kind.tolist(), s.code.tolist(), s.value.tolist()
        for a in range(len(kinds) - w + 1):
            ends = {a + w: kinds[a : a + w].count(0) >= min(5, w)}
            literal = [k for k in range(a, len(kinds)) if not kinds[k]]
            if wide and not ends[a + w] and len(literal) >= 5:
                ends[literal[4] + 1] = True
            for end, enough in ends.items():
                at = [k for k in range(a, end) if kinds[k]]
                seen = {}
                order = tuple(seen.setdefault((kinds[k], values[k]), len(seen)) for k in at)
                out.append(((enough, tuple((codes if enough else list(zip(values, kinds, strict=True)))[a:end]), order), a, end - a, [values[k] for k in at]))
        return out

    want = {}
    for d, text in enumerate(docs):
        s = read(text)
        for i, item in enumerate(items):
            t, size = read(item), len(read(item).code)
            w = min(8, size)
            mine, theirs = places(s, w, w == 8), places(t, w, w == 8)
            diagonals = {}
            for key, a, wide, slots in mine:
                for other, b, _, item_slots in theirs:
                    if key == other:
                        diagonals.setdefault(a - b, []).append((a, wide, slots, item_slots))
            good = []
            for found in diagonals.values():
                became = {}
                for a, wide, slots, item_slots in sorted(found, key=lambda f: f[:2]):
                    if all(became.get(x, y) == y for x, y in zip(item_slots, slots, strict=True)):
                        became.update(zip(item_slots, slots, strict=True))
                        good.append((a, a + wide))
            run = best = 0
            flat = sorted({k for a, b in good for k in range(a, b)})
            for k, at in enumerate(flat):
                run = run + 1 if k and flat[k - 1] == at - 1 else 1
                best = max(best, run)
            if best >= min(12, size):
                want[d, i] = best
    table = spark.createDataFrame(list(enumerate(items)) + [(None, items[0]), (99, None)], "item_id long, text string")
    odd = frame(spark, [*docs, items[0], docs[0], items[6]], [*range(len(docs)), None, 0, 70]).withColumn("item_id", F.lit(1)).withColumn("template", F.lit("x"))
    got = {(r.doc_id, r.item_id): r.n_symbols for r in decontaminate.contaminated(odd, table).collect()}
    want |= {(70, i): len(read(items[6]).code) for i in range(12) if items[i] == items[6]}
    assert {k: v for k, v in got.items() if k[0] not in (0, 70)} == {k: v for k, v in want.items() if k[0] not in (0, 70)} and (70, 6) in got and len(want) > 10


EMPTY = {
    "quality": lambda d, s: quality.classify(d, s.createDataFrame([(1, 1)], "doc_id long, quality int")),
    "pst": lambda d, s: pst.score(d),
    "packing": lambda d, s: packing.pack(d),
    "lines": lambda d, s: line_dedup.remove_repeats(d),
    "media": lambda d, s: jpeg.features(jpeg.store(d)),
    "simhash": lambda d, s: simhash.near_duplicates(d),
    "substrings": lambda d, s: substring_dedup.remove_repeats(d),
}


@pytest.mark.parametrize("name", sorted(EMPTY))
def test_empty_tables_and_odd_rows(spark, name):
    docs = frame(spark, ["a b", None])
    assert EMPTY[name](docs.limit(0), spark).count() == 0
    odd = frame(spark, [None, "", "same text here", "same text here", "x " * 40_000, None], [None, 1, 1, 1, 2, None])
    ids = Counter(r.doc_id for r in EMPTY[name](odd, spark).select("doc_id").collect())
    assert set(ids) == {None, 1, 2} and (name == "packing" or ids == Counter({1: 3, None: 2, 2: 1}))
