import random
import re

from signalloom.llm import html_extract as H
from signalloom.llm import secret_scan as S


def brute_spans(text):
    out = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m.group(1)) >= 12:
            out.append(f"assign:{m.start()}:{m.end()}")
    out += [f"access:{m.start()}:{m.end()}" for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out, key=lambda s: (int(s.split(":")[1]), S.KINDS.index(s.split(":")[0])))


def test_base_spans(spark):
    rng = random.Random(2)
    pieces = ["password", "API_KEY", "apikey", "Secret", "token", '"', "'", " ", "=", ":", "abcdef", "0123456789", "AKIA", "ABCDEFGHIJKLMNOP", "-", "é", "ſecret", "\n"]
    texts = [None, "", "x" * 5000 + " token=" + "a" * 3000] + ["".join(rng.choice(pieces) for _ in range(rng.randint(2, 14))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1, texts[10])], "doc_id long, text string")
    rows = S.digests(S.scan(docs)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if (r["doc_id"], r["spans"]) and r["doc_id"] != 1:
            want = brute_spans(texts[r["doc_id"]] or "")
            assert [s for s in r["spans"].split(",") if s and not s.startswith("novel")] == want
    assert S.scan(docs.limit(0)).count() == 0


def test_novel_strings_in_sensitive_context():
    names = ["connection_settings_v2", "session_token_cache_v1", "private_key_file_name"]
    novelty = S.Novelty(names, 3.5)
    text = "def load(): credential -> Zk9QwX72LmPf04TyBvRe8sHd and then\nauth uses session_token_cache_v1 again, price 12345678901234567890"
    found = novelty.spans(text, S.base_spans(text))
    assert [text[a:b] for a, _, b in found] == ["Zk9QwX72LmPf04TyBvRe8sHd"]
    assert novelty.spans("nothing near Zk9QwX72LmPf04TyBvRe8sHd", []) == []


def test_strings_within_reach_on_either_side():
    novelty, secret = S.Novelty([], 3.5), "Zk9QwX72LmPf04TyBvRe8sHd"
    found = lambda text: [text[a:b] for a, _, b in novelty.spans(text, S.base_spans(text))]
    for gap in (1, 32, 33, 47, 48):
        assert found("credential" + " " * gap + secret + " end") == [secret], gap
        assert found("it is " + secret + " " * gap + "credential") == [secret], gap
    assert found("credential" + " " * 49 + secret) == found(secret + " " * 49 + "credential") == []
    assert found(f"| {secret} | session |") == [secret]
    assert found("'key': {'type': 'string', 'value': '" + secret + "'}") == [secret]
    whole = "".join(random.Random(4).choices("ABCDEFGHJLMNPQRSTUVWXYZabcdefghjlmnpqrstuvwxyz23456789", k=100))
    assert found("credential" + " " * 40 + whole) == [whole]  # to its end, beyond the reach
    assert found(f"auth/{secret}") == ["/" + secret] and found(f"{secret}/auth") == [secret + "/"]


def brute_novel(text, novelty):
    """By the definition: every long string against every sensitive word."""
    words = [m.span() for m in re.finditer("|".join(S._NEAR), text, re.I | re.A)]
    base, found = S.base_spans(text), []
    for m in re.finditer(r"[A-Za-z0-9+/_=.-]{16,}", text):
        a, b = m.span()
        outside = any(0 <= a - e <= 48 or 0 <= s - b <= 48 for s, e in words)
        inside = [w for w in words if w[0] < b and w[1] > a]
        if outside:
            pieces = [(a, b)]
        else:
            edges = [a] + [x for w in inside for x in w] + [b]
            pieces = [(x, y) for x, y in zip(edges[::2], edges[1::2]) if y - x >= 16] if inside else []
        for x, y in pieces:
            word = text[x:y]
            if re.search("[0-9]", word) and re.search("[A-Za-z]", word) and not any(s < y and x < e for s, _, e in base):
                if 8 * novelty.marginal(text, x, y) >= novelty.least * len(word):
                    found.append((x, "novel", y))
    return sorted(found)


def test_novel_spans_equal_brute_force():
    rng = random.Random(12)
    random_text = lambda n: "".join(rng.choice("ABCDEFGHJLMNPQRSTUVWXYZabcdefghjlmnpqrstuvwxyz23456789+/") for _ in range(n))
    novelty = S.Novelty(["connection", "settings", "session_cache"], 3.5)
    some = 0
    for _ in range(400):
        pieces = [rng.choice([random_text(rng.randint(10, 60)), "credential", "auth", "key", " " * rng.randint(1, 60), "connection_settings_v2_connection", "plain words", "=", "|", "bearer/" + random_text(20)]) for _ in range(rng.randint(2, 9))]
        text = "".join(pieces)
        want = brute_novel(text, novelty)
        some += len(want)
        assert novelty.spans(text, S.base_spans(text)) == want
    assert some > 200


def test_a_secret_stays_novel_in_several_documents(spark):
    secret = "Zk9QwX72LmPf04TyBvRe8sHd"
    rows = [(i, f"note {i}: credential -> {secret} and more") for i in range(5)] + [(9, "nothing here"), (10, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, n int")
    out = {r["doc_id"]: r["n_novel"] for r in S.digests(S.scan(docs)).collect()}
    assert out == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 9: 0, 10: 0}


def test_one_long_string_is_linear_work():
    import base64
    import time

    raw = base64.b64encode(random.Random(1).randbytes(3 << 20)).decode()
    novelty, began = S.Novelty([], 3.5), time.time()
    assert len(S.near_strings("key " + raw)) == 1
    pieces = S.near_strings(raw)
    assert all(a[1] <= b[0] for a, b in zip(pieces, pieces[1:])) and sum(b - a for a, b in pieces) <= len(raw)
    assert novelty.spans("key " + raw, [])
    assert time.time() - began < 60


PAGE = "<html><body><nav><a>Home of the very best things ever</a></nav>{main}<div>Follow us on every network you can think of today</div><footer>bye</footer></body></html>"


def test_structure_and_host_boilerplate(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.format(main=f"<div>Story {i} tells of {'x' * (i + 1)} and y{i} in town {i} &amp; more</div>")) for i in range(4)]
    rows += [(10, "https://b.example/", PAGE.format(main="<article><h1>T</h1><p>one<br>two&nbsp;<b>th</b>ree<p>four<div class='comments'><p>no</div></article>"))]
    rows += [(11, None, None), (12, "x", ""), (13, "https://a.example/0?copy", rows[0][2]), (0, "https://a.example/0", rows[0][2])]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = H.extract(docs).collect()
    assert len(out) == len(rows)
    got = {(r["page_id"], r["url"]): r["text"] for r in out}
    for i in range(4):  # the line every page of the host has goes, the story stays, also on the page that has a copy
        assert got[i, f"https://a.example/{i}"] == f"Story {i} tells of {'x' * (i + 1)} and y{i} in town {i} & more"
    assert got[10, "https://b.example/"] == "T\none two three\nfour" and got[11, None] == "" and got[12, "x"] == ""
    assert H.extract(docs.limit(0)).count() == 0


def test_broken_pages():
    main = lambda h: [t for z, t in H.blocks(h) if z == "main"]
    assert main("<article><p>a<p>b") == ["a", "b"]
    assert main("<article><p>a <script>if (x<1) '</p>'</script>b</p></article><p>c") == ["a b"]
    assert main('<article><p title="x>y">a</p><!-- <p>no') == ["a"]
    assert main("<article>a < b &lt;i&gt; &copy 1 <a href='") == ["a < b <i> © 1"]
    assert main("<article><form><p>no</p></form><ul><li>i<li>j</ul><aside>no</aside>") == ["i", "j"]
    assert main("<article><p>" + "long " * 50_000) == [("long " * 50_000).strip()]


def brute_bare(pages, length=6, least=3, share=0.2):
    """Texts of one host's pages without an article: every window of six words of every page against all others."""
    streams = [[tuple(b.split()) for b in page] for page in pages]
    distinct = set(map(tuple, streams))
    on = {}
    for page in distinct:
        for block in page:
            step = min(length, len(block))
            for i in range(len(block) - step + 1 if step else 0):
                on.setdefault((step, block[i : i + step]), set()).add(page)
    out = []
    for page in streams:
        kept = []
        for block in page:
            step, cut = min(length, len(block)), set()
            for i in range(len(block) - step + 1 if step else 0):
                n = len(on[step, block[i : i + step]])
                if n >= least and n >= share * len(distinct):
                    cut |= set(range(i, i + step))
            kept.append(" ".join(w for i, w in enumerate(block) if i not in cut))
        out.append("\n".join(t for t in kept if t))
    return out


def test_repeated_runs_of_a_host_equal_brute_force(spark):
    rng = random.Random(21)
    line = [f"b{i}" for i in range(20)]
    pages = []
    for _ in range(14):
        page = []
        for _ in range(rng.randint(1, 5)):
            at = rng.randint(0, 12)
            page.append(" ".join(rng.choice([line[at : at + rng.randint(1, 9)], [f"u{rng.randint(0, 60)}" for _ in range(rng.randint(1, 9))]]) + rng.choice([[], line[:7], ["x"]])))
        pages.append(page)
    pages += [pages[0], pages[1]]
    rows = [(i, f"https://h.example/{i}", "<body>" + "".join(f"<div>{b}</div>" for b in page) + "</body>", "t") for i, page in enumerate(pages)]
    out = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)).collect()}
    want = brute_bare(pages)
    assert [out[i] for i in range(len(pages))] == want
    assert any(len(w) < sum(map(len, p)) for w, p in zip(want, pages)) and all(isinstance(w, str) for w in want)


def test_unique_words_stay_and_boilerplate_is_counted(spark):
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "https://two.example/x", f"<div>{same} only{i}</div>") for i in range(2)]
    rows += [(10 + i, "https://five.example/x", f"<div>{same} only{i}</div>") for i in range(5)]
    rows += [(20 + i, "https://art.example/x", f"<article><p>story {i}</p></article><div>{same}</div>") for i in range(4)]
    out = {r["page_id"]: (r["text"], r["n_boilerplate"]) for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == (f"{same} only{i}", 0) for i in range(2))
    assert all(out[10 + i] == (f"only{i}", 60) for i in range(5))
    assert all(out[20 + i] == (f"story {i}", 60) for i in range(4))


def test_marks_inside_articles():
    main = lambda h: [t for z, t in H.blocks(h) if z == "main"]
    page = '<article><section id="search-trees"><p>a</p></section><h2 id="legal-history">b</h2><div class="notice-of-work">c</div><div class="big ad">no</div><div role="navigation">no</div><p>d</p></article>'
    assert main(page) == ["a", "b", "c", "d"]
    assert [z for z, _ in H.blocks('<div id="site-footer">x</div><div class="ad-box">y</div><div>z</div>')] == ["chrome", "chrome", "open"]
