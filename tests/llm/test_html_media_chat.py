import hashlib
import json
import math
import struct
import zlib

import numpy as np
import pytest
from helpers import clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from veriloom.llm import chat, media
from veriloom.llm.html import BLOCK, Page, extract, main_text

LONG = "This sentence is long enough to count as the text of an article, or so one would think. " * 3


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body>{body}</body></html>"


def test_article_without_furniture():
    body = f"""<header><a href=/>Home</a></header><nav><ul><li><a href=a>A</a></ul></nav><div class="cookie-notice">We use cookies {LONG}</div>
    <article><h1>Head &amp; line</h1><p>{LONG}<p>Second&nbsp;  para<br>graph <a href=x>link</a></p><ul><li>one<li>two</ul><form><input>Send</form></article>
    <aside>Side {LONG}</aside><div id="comments"><p>{LONG}</p></div><!-- {LONG} --><footer>&copy; {LONG}</footer>"""
    assert main_text(page(body)) == "\n\n".join(["Head & line", LONG.strip(), "Second para graph link", "one", "two"])


def test_densest_part_without_article():
    links = "".join(f"<li><a href={i}>menu entry {i}</a>" for i in range(30))
    body = f"<div><ul>{links}</ul></div><div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div>"
    assert main_text(page(body)) == "\n\n".join([LONG.strip()] * 3)


@pytest.mark.parametrize(("source", "text"), [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<p>a</b></i>b", "ab"), ("<p>&#65;&lt;b&gt;", "A<b>"), ("<<>< a < b", "<<>< a < b"), ("<script>x", ""), ("<div hidden>x</div>", "")])
def test_odd_markup(source, text):
    assert main_text(source) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<td>", "<table>", "</table>", "<li>", "<article>", "</article>", "<a href='", "'", '"', ">", "<", "x y", "&amp;", "<!--", "-->", "<script>", "</script>"]), max_size=30).map("".join))
def test_never_crashes(source):
    assert isinstance(main_text(source), str)


def plainly(source):
    """Densities and sums by walking each subtree on its own, straight from the formula."""
    p = Page(source)
    n = len(p.tag)
    below = [[j for j in range(n) if j == i or any(a == i for a in ancestors(p, j))] for i in range(n)]
    block = [any(p.tag[j] in BLOCK for j in b) for b in below]
    linked = [any(p.tag[a] == "a" for a in (i, *ancestors(p, i))) for i in range(n)]
    size = [sum(len(" ".join(t.split())) for i, t, _ in p.texts if i == j) for j in range(n)]
    body = p.tag.index("body") if "body" in p.tag else 0

    def composite(nodes, top):
        c, lc = sum(size[j] for j in nodes), sum(size[j] for j in nodes if linked[j])
        t, lt = sum(j != top for j in nodes) or 1, sum(j != top and p.tag[j] == "a" for j in nodes) or 1
        all_c, all_lc = sum(size[j] for j in below[body]), sum(size[j] for j in below[body] if linked[j])
        if not c or not all_lc:
            return c / t
        base = math.log((c / (c - lc or 1)) * lc + all_lc / all_c * c + math.e)
        return c / t * max(0.0, math.log(c / (lc or 1) * t / lt, base))

    density = [composite(below[i], i) for i in range(n)]
    gone = p.furniture()
    sums = []
    for i in range(n):
        own = [j for j in below[i] if j == i or not block[j] and not any(block[a] for a in ancestors(p, j) if a > i)]
        sums.append(composite(own, i) + sum(density[j] for j in range(n) if p.parent[j] == i and block[j] and not gone[j]) if block[i] else 0.0)
    return density, sums


def ancestors(p, i):
    while p.parent[i] >= 0:
        i = p.parent[i]
        yield i


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<nav>", "</nav>", "<a href=x>", "</a>", "<body>", "some words here", "more ", "<br>", "<div class=ad>"]), max_size=30).map("".join))
def test_densities_and_sums_by_the_formula(source):
    p = Page(source)
    density, sums = plainly(source)
    assert np.allclose(p.density, density) and np.allclose(p.sums(p.furniture()), sums)


ONE = LONG.strip()
WRAPPED = {
    "a form around the article": (f"<form><article><h1>T</h1><p>{LONG}</p><p>x.</p></article></form>", ["T", ONE, "x."]),
    "a form around all": (f"<form><p>{LONG}</p><p>{LONG}</p><input name=q><button>Go</button></form><div class=ad>Buy</div>", [ONE, ONE]),
    "a name of other words": (f'<div class="search-result"><article><p>{LONG}</p></article></div>', [ONE]),
    "a paragraph of another name": (f'<article><p>{LONG}</p><p class="related-work">Related.</p><section class="comment-list"><p>First! {LONG}</p></section></article>', [ONE, "Related."]),
    "named furniture around the article": (f'<div class="widget"><article><p>{LONG}</p><p>y</p></article></div>', [ONE, "y"]),
    "no article, with a sidebar": (f'<div id=wrap><nav><a href=x>a</a></nav><div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p>s.</p></div><div class="sidebar">{LONG}</div></div>', ["Head", ONE, ONE, "s."]),
    "sections": (f"<div><div><h2>H</h2><p>{LONG}</p><p>b</p></div><div><p>{LONG}</p><p>{LONG}</p><p>tiny</p></div></div><div><ul><li><a href=1>aaa</a><li><a href=2>bbb</a></ul></div>", ["H", ONE, "b", ONE, ONE, "tiny"]),
    "menus beside text of one block": ("<div><ul>" + "".join(f"<li><a href={i}>entry {i}</a>" for i in range(20)) + f"</ul></div><div>{LONG}<br>{LONG}</div>", [f"{ONE} {ONE}"]),
    "denser text beside an article": (f"<article><p>Short.</p></article><div><p>{LONG}</p><p>{LONG}</p></div>", [ONE, ONE]),
    "nothing but furniture": ("<nav>only a menu</nav><footer>foot</footer>", []),
}


@pytest.mark.parametrize("case", WRAPPED)
def test_density_decides(case):
    body, blocks = WRAPPED[case]
    assert main_text(page(body)) == "\n\n".join(blocks)


def test_ties_and_long_pages():
    assert main_text(page(f"<div><p>{LONG}</p></div><div><p>{LONG}</p></div>")) == "\n\n".join([ONE, ONE])
    many = [f"Paragraph {i}. {LONG}".strip() for i in range(20_000)]
    assert main_text(page("<article>" + "".join(f"<p>{t}" for t in many) + "</article>")) == "\n\n".join(many)


def test_deep_nesting():
    assert main_text("<div>" * 20_000 + "deep") == "deep"


def test_pages_rows(spark):
    df = spark.createDataFrame([(1, "u", page(f"<article><p>{LONG}</article>")), (2, None, None), (1, "u", ""), (None, "v", "x")], "page_id long, url string, html string")
    out = extract(clashing(df).withColumn("text", df["url"])).collect()
    assert len(out) == 4 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert extract(df.limit(0)).count() == 0


# ------------------------------------------------------------------ media


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=2000))
def test_png_round_trip(raw):
    payload = raw + b"\0" * (-len(raw) % 64 or 64)
    assert media.decode_png(media.encode_png(payload)).tobytes() == payload


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.binary(min_size=8, max_size=8)), min_size=1, max_size=12))
def test_all_row_filters(rows):
    """Decoding against a filter written out sample by sample."""
    above, lines, want = bytes(8), b"", []
    for kind, row in rows:
        line = bytearray()
        for i, x in enumerate(row):
            left, up, corner = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            line.append((x - (0, left, up, (left + up) // 2, paeth)[kind]) & 255)
        lines += bytes([kind]) + line
        want.append(row)
        above = row
    chunk = media._chunk
    data = media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert media.decode_png(data).tobytes() == b"".join(want)


def test_damage_is_seen():
    data = bytearray(media.encode_png(b"x" * 640))
    for at in (3, 20, 45, len(data) - 1):
        bad = data[:]
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(bytes(data[:-12]))


def test_media_rows(spark):
    texts = ["hello", None, "", "é" * 100_000, "hello"]
    df = clashing(documents(spark, texts))
    out = {r["doc_id"]: r for r in media.media_digest(media.media_columns(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert out[0]["media_sha256"] == out[4]["media_sha256"] and out[0]["feature"] == out[4]["feature"] and out[1]["feature"] == out[2]["feature"]
    assert media.media_digest(media.media_columns(df.limit(0))).count() == 0


def test_hash_follows_the_low_frequencies():
    rng = np.random.default_rng(0)
    image, other = (np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8) for _ in range(2))
    noisy = np.clip(image.astype(int) + rng.integers(-3, 4, image.shape), 0, 255).astype(np.uint8)
    a, b, c = (int.from_bytes(media.cosine_hash(m), "big") for m in (image, noisy, other))
    assert (a ^ b).bit_count() <= 6 < 16 < (a ^ c).bit_count()


# ------------------------------------------------------------------ chat

pieces = st.lists(st.sampled_from(["\\", "###", "#", "</turn>", "</", "turn>", " ", "\n", ": ", "a", "é", "### Assistant: "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(pieces, pieces), max_size=4))
def test_template_reads_back(turns):
    segments = [chat.format_turn(r, t) for r, t in turns]
    assert chat.read_segments("".join(s for s, _, _ in segments)) == turns
    for (s, a, b), (_, t) in zip(segments, turns, strict=True):
        assert chat._BACK.sub(r"\1", s[a:b]) == t


def test_layouts():
    want = [("user", "q"), ("assistant", "r")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}], "id": 3},
        {"prompt": "q", "response": "r", "score": 0.3},
        {"instruction": "q", "input": "", "output": "r"},
        {"prompt": "q", "completion": "r"},
        {"question": "q", "answer": "r", "meta": {"a": [1, 2]}},
    ]
    assert all(chat.record_turns(r) == want for r in records)
    assert len({chat.fingerprint(chat.value_paths(r)) for r in records}) == len(records)
    assert chat.record_turns({"system": "s", "prompt": "q", "response": "r"}) == [("system", "s"), *want]
    assert chat.record_turns({"other": 1}) is None and chat.record_turns([1]) is None


def test_tables_of_layouts(spark):
    flat = spark.createDataFrame([(1, "q", "", "r")], "conv_id long, instruction string, input string, output string")
    nested = spark.createDataFrame([(1, [("human", "q"), ("gpt", "r")])], "conv_id long, conversations array<struct<from: string, value: string>>")
    for df in (flat, nested):
        assert [(r["role"], r["text"]) for r in chat.turns_of_table(df).orderBy("turn").collect()] == [("user", "q"), ("assistant", "r")]
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.range(1))
    odd = spark.createDataFrame([(1, "no json"), (2, None), (3, json.dumps({"prompt": "q", "response": None}))], "conv_id long, record string")
    got = {}
    for r in chat.turns_of_json(odd).orderBy("turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {1: [(None, "no json")], 2: [(None, None)], 3: [("user", "q"), ("assistant", "")]}


def test_chat_rows(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", said), (1, 2, "assistant", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "assistant", "n")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.chat_digest(chat.format_chat(chat.turns_of_table(clashing(df)))).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0], r[1] or "", r[2] or ""))
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        r = out[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digest(chat.format_chat(chat.turns_of_table(df.limit(0)))).count() == 0
