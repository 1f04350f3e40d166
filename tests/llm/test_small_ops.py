"""URL rules, conversations and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

from odspark.llm import chat_events, decontam, url_filter
from odspark.llm.queries import conversation_events
from tests_llm_texts import messy_texts

UP = {c: c + 32 for c in range(65, 91)}


def brute_url(url, rules):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host, best = host.translate(UP), None
    for action, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or len(rule) > len(best[1]):
                best = (action, rule)
    return host, path, *(best or (None, None))


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com", "https://example.com/en/x?y#z", "http://a.b.example.com/en/",
        "http://www.example.com/en/a", "http://notexample.com/en/", "ftp://x.net/es/1", "http://x.net?/es/", "http://x.net#/fr/",
        "http://net/fr/", "http://x.net/fr", "http://x.org/a://b.com/", "http://exa.mple.net/es/\nline", "http://a..com/", "http://com/"]


def test_judge_urls(spark):
    rows = [(i, u, None, "x") for i, u in enumerate(URLS + URLS[5:8])]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    for rules in (url_filter.RULES, []):
        got = url_filter.judge_urls(d, rules).collect()
        assert len(got) == len(rows)
        for r in got:
            host, path, action, rule = brute_url(rows[r.page_id][1], rules)
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, action or "allow"), rows[r.page_id]
    assert url_filter.judge_urls(d.limit(0), url_filter.RULES).count() == 0


def test_many_rules_are_a_table(spark):
    """20,000 rules by a join, and the same answers as in the plan."""
    rules = [(("allow", "block")[i % 3 == 0], f"h{i % 700}.net/{'abc'[i % 3] * (i % 5)}{i % 40}") for i in range(20_000)]
    rules += [*url_filter.RULES, ("allow", "net/"), ("block", "h3.net/")]
    urls = URLS + [f"http://{sub}h{i}.net/{'abc'[i % 3] * k}{j}" for i in range(0, 705, 47) for sub in ("", "x.") for k in range(5) for j in (7, 39)]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[5:9])], "page_id long, url string")
    got = url_filter.judge_urls(d, rules, html=None).collect()
    assert len(got) == len(urls) + 4
    for r in got:
        host, path, action, rule = brute_url(r.url, rules)
        best = max((len(x), a == "allow", x) for a, x in rules if x == rule or (
            rule and len(x) == len(rule) and (host == x.split("/")[0] or host.endswith("." + x.split("/")[0]))
            and path.startswith("/" + x.split("/", 1)[1]))) if rule else None
        assert (r.host, r.path, r.rule) == (host, path, best and best[2]), r
        assert r.verdict == ("allow" if best is None or best[1] else "block")
    small = spark.createDataFrame([(u, *brute_url(u, [])[:2]) for u in urls], "url string, host string, path string")
    few = rules[:40] + rules[-7:]
    both = [{(x.url, x._m) for x in url_filter.with_rule(small, few, limit).collect()} for limit in (0, 500)]
    assert both[0] == both[1]


def test_allow_goes_before_block_on_one_rule(spark):
    d = spark.createDataFrame([(1, "http://x.net/es/1")], "page_id long, url string")
    for rules in ([("allow", "net/es/"), ("block", "net/es/")], [("block", "net/es/"), ("allow", "net/es/")]):
        for extra in ([], [("block", f"h{i}.org/") for i in range(600)]):
            assert url_filter.judge_urls(d, rules + extra, html=None).first().verdict == "allow"


def test_blocks_reach_aliases_but_not_allowed_urls(spark):
    page = '<head><link rel="canonical" href="%s"></head>'
    moved = '<meta http-equiv="refresh" content="0; url=%s">'
    rows = [(1, "http://bad.example.com/en/1", ""), (2, "http://alias.org/2", page % "http://bad.example.com/en/1"),
            (3, "http://far.org/3", moved % "http://alias.org/2"), (4, "http://ok.com/", page % "http://far.org/3"),
            (5, "http://free.org/5", page % "http://other.org/x"), (6, "http://free.org/6", None),
            (7, "http://log.org/7", "<p>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    logs = spark.createDataFrame([("http://log.org/7", "http://far.org/3"), (None, "http://far.org/3")], "src string, dst string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(d, url_filter.RULES, edges=logs).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block"}


def test_components_on_paths_and_stars(spark):
    from odspark.llm.components import components
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 300), (400, 401), (401, 400)]
    r.shuffle(edges)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(80))
    assert got[400] == got[401] == 400 and 300 not in got


def test_components_on_shuffled_paths(spark):
    from odspark.llm.components import components
    r = random.Random(3)
    edges = []
    for k, n in enumerate((1200, 300)):
        nodes = list(range(10_000 * k, 10_000 * k + n))
        r.shuffle(nodes)
        edges += list(zip(nodes, nodes[1:]))
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 10_000 * 10_000 for i in [*range(1200), *range(10_000, 10_300)]}


def test_relative_repeated_and_escaped_targets(spark):
    page = '<head><link rel="canonical" href="%s"></head>'
    moved = '<meta http-equiv="refresh" content="0; url=%s">'
    rows = [(1, "http://x.net/old", page % "/es/new"), (2, "http://a.org/2", page % "//y.net/fr/2"),
            (3, "http://z.net/es2/a/b", moved % "../../es/3"), (4, "http://q.net/n?x", page % "es/4"),
            (5, "http://e.net/es/5?a=1&b=2", ""), (6, "http://f.org/6", page % "http://E.NET/es/5?a=1&amp;b=2"),
            (7, "http://G.org/7", ""), (8, "http://h.org/8", page % "http://g.org/7" + page % "http://t.net/es/8"),
            (9, "http://i.org/9", page % "#top" + page % "mailto:a@b.net"), (10, "no scheme", page % "/es/x"),
            (11, "http://j.org/p?u=1", page % "/r?u=http://k.net/es/")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(d, url_filter.RULES).collect()}
    assert got == {i: "allow" if i in (9, 10, 11) else "block" for i in range(1, 12)}


def brute_conversations(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1]))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        out[conv] = (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations_read_back(spark):
    r = random.Random(4)
    ctrl = chat_events.CONTROL + ["\\", "\\\\|", "\\|", "<\\|", "😀", "\n", " "]
    rows = []
    for conv in [None, -5, 1, 2, 3]:
        for turn in range(12):
            text = r.choice([None, "", "x" * 700, "".join(r.choice(ctrl) for _ in range(30)), messy_texts(turn, 20)[-1]])
            rows.append((conv, turn, r.choice(["user", "assistant", "system", "", None, "<|end|>"]), text))
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("turn", "turn")
    got = chat_events.digest(chat_events.render(chat_events.fold_events(conversation_events(d)))).collect()
    assert {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in got} == brute_conversations(rows)
    none = chat_events.digest(chat_events.render(chat_events.fold_events(conversation_events(d.limit(0)))))
    assert none.count() == 0


def test_event_log_supersedes_turns(spark):
    """The derived log holds drafts, edits and regenerations, and the fold undoes them, whatever the order of rows;
    repeated (conv, turn) rows are turns of their own; further columns are not read."""
    rows = [(i % 5, i // 5 % 9, ("user", "assistant", None)[i % 3], f"text {i} " * (i % 50), i, "x") for i in range(120)]
    rows += [(1, 2, "user", None, 0, "x"), (1, 2, "user", None, 0, "y"), (None, 0, "assistant", "lone", 0, "z")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq long, kind string")
    events = conversation_events(d)
    log = events.collect()
    assert {e.kind for e in log} == {"message", "delta", "edit", "regenerate"}
    assert sum("draft" in (e.text or "") for e in log) > 50
    by_turn = Counter((e.conv_id, e.position) for e in log)
    assert len(by_turn) == len(rows) and max(by_turn.values()) >= 5
    # in the order of the conversation's sequence, another turn's events stand between those of a turn
    order = [e.position for e in sorted((e for e in log if e.conv_id == 1), key=lambda e: e.seq)]
    assert sum(a != b for a, b in zip(order, order[1:])) > len(set(order))
    turns = chat_events.fold_events(events.orderBy("text", "kind")).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(((t.conv_id, t.position.turn, t.role, t.text) for t in turns), key=key)
    assert got == sorted(((c, t, r, x or "") for c, t, r, x, *_ in rows), key=key)


def test_no_control_string_survives(spark):
    r = random.Random(6)
    texts = ["".join(r.choice(chat_events.CONTROL + ["\\", "|", "<", "["]) for _ in range(20)) for _ in range(100)]
    from pyspark.sql import functions as F
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_events.escape(F.col("t")).alias("e"))
    for t, e in d.collect():
        assert chat_events.unescape(e) == t and not any(c in e for c in chat_events.CONTROL)


def test_fold_events(spark):
    log = [(1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", ""), (1, 1, 3, "delta", "assistant", "A"),
           (1, 1, 5, "delta", "assistant", "C"), (1, 1, 4, "delta", "assistant", "B"), (1, 1, 6, "regenerate", "assistant", "zz"),
           (1, 1, 7, "delta", "assistant", "new"), (1, 0, 8, "edit", "user", "hello"), (1, 2, 9, "delta", "user", "late"),
           (1, 3, 10, "message", "user", None), (2, 0, None, "message", None, "n")]
    d = spark.createDataFrame(log, "conv_id long, position long, seq long, kind string, role string, text string")
    got = sorted(tuple(r) for r in chat_events.fold_events(d).collect() if r.role)
    assert got == [(1, 0, "user", "hello"), (1, 1, "assistant", "new"), (1, 2, "user", "late"), (1, 3, "user", "")]


def brute_contaminated(texts, items):
    def grams(w, k):
        return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    space = re.compile(r"[^\x20\x09-\x0D]+")
    out = set()
    for d, t in enumerate(texts):
        w = space.findall((t or "").lower())
        for i, item in items:
            x = space.findall((item or "").lower())
            if not x or not w:
                continue
            k, n = min(5, len(x)), min(len(x), len(w))
            want = grams(x, k)
            for s in range(len(w) - n + 1):
                have = grams(w[s:s + n], k)
                common = sum((want & have).values())
                if common and 100 * common >= 75 * (sum(want.values()) + sum(have.values()) - common):
                    out.add((d, i))
                    break
    return out


def decontam_rows(rows):
    from pyspark.sql import Row
    out = []
    for r in rows:
        d = r.asDict()
        d.pop("item_row")
        out.append(Row(**d))
    return out


def test_contaminated(spark, docs, empty_docs, monkeypatch):
    r = random.Random(8)
    vocab = ["w%d" % i for i in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 5, 9, 20, 45])))) for i in range(14)]
    items += [(90, None), (91, ""), (92, items[3][1]), (93, "a a a a a a a a")]
    texts = messy_texts(13, 30)
    for _ in range(90):
        words = items[r.randrange(14)][1].split()
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            words[r.randrange(len(words))] = "edit"
        pad = [" ".join(r.choice(vocab) for _ in range(r.randrange(20))) for _ in range(2)]
        texts.append(f"{pad[0]} {' '.join(words).upper() if r.random() < .3 else ' '.join(words)}\n{pad[1]}")
    texts.append("a a a a a a a a a a")
    table = spark.createDataFrame(items, "item_id long, text string")
    frame = docs(texts, clash=True)
    got = decontam.contaminated(frame, table).collect()
    assert {(x.doc_id, x.item_id) for x in got} == brute_contaminated(texts, items)
    monkeypatch.setattr(decontam, "MAX_BROADCAST", 0)  # items too many to broadcast
    assert sorted(decontam.contaminated(frame, table).drop("item_row").collect()) == sorted(
        x for x in decontam_rows(got))
    monkeypatch.undo()
    clean = {x.doc_id for x in decontam.clean_documents(frame, table).collect()}
    assert clean == set(range(len(texts))) - {x.doc_id for x in got}
    assert decontam.contaminated(empty_docs, table).count() == 0
    assert decontam.contaminated(frame, table.limit(0)).count() == 0


def test_hamming_blocks_find_all_within_radius(spark):
    """Pigeonhole: any two fingerprints within the radius share a block."""
    from pyspark.sql import functions as F
    r = random.Random(9)
    pairs = []
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), r.randrange(0, decontam.RADIUS + 1)):
            b ^= 1 << k
        pairs.append((a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    d = spark.createDataFrame(pairs, "a long, b long").withColumn("id", F.monotonically_increasing_id())
    x = d.select("id", decontam.blocks(F.col("a"), decontam.RADIUS))
    y = d.select("id", decontam.blocks(F.col("b"), decontam.RADIUS))
    assert x.join(y, ["id", "_b"]).select("id").distinct().count() == len(pairs)


def test_contaminated_by_items_in_another_order(spark, docs):
    """Halves swapped, parts reversed, repeated words: the best window lies between the laid ones."""
    r = random.Random(12)
    items, texts = [], []
    for i, (n, cuts) in enumerate([(100, [50]), (60, [30]), (200, [160]), (100, [25, 50, 75]), (40, [20]), (30, [10])]):
        words = [f"i{i}w{k}" if k % 9 else "_" for k in range(n)]
        items.append((i, " ".join(words)))
        parts = [words[a:b] for a, b in zip([0, *cuts], [*cuts, n])][::-1]
        moved = [w for p in parts for w in p]
        pad = [f"pad{k}" for k in range(r.randrange(40, 90))]
        texts += [" ".join(pad + moved + pad), " ".join(moved), " ".join(pad + moved), " ".join(moved[:n // 2] + pad + moved[n // 2:])]
    items.append((9, "_ _ _ _ _ _ _ _ " + " ".join(f"x{k}" for k in range(30))))
    texts.append(" ".join([f"x{k}" for k in range(30)] + ["_"] * 8 + ["_", "end"]))
    got = decontam.contaminated(docs(texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_contaminated(texts, items)
    assert {(x.doc_id, x.item_id) for x in got} == want and len(want) >= 10
    for x in got:  # the figures are those of the window shown
        w, item = texts[x.doc_id].split(), dict(items)[x.item_id].split()
        have, need = [Counter(tuple(t[a:a + 5]) for a in range(len(t) - 4))
                      for t in (w[x.window_start:x.window_start + x.window_words], item)]
        common = sum((have & need).values())
        assert (x.n_common, x.n_union) == (common, sum(have.values()) + sum(need.values()) - common)


def test_heavy_shingles_do_not_hide_the_laid_window(spark, docs):
    """A run of one word swings all bits of a fingerprint; the similarity stays 120 of 156."""
    items = [(i, " ".join([f"q{i}w{k}" for k in range(124)] + [f"_{i}"] * 18)) for i in range(12)]
    texts = [" ".join([f"pad{k}" for k in range(40)] + [f"q{i}w{k}" for k in range(124)] + [f"={i}"] * 18
                      + [f"pad{k}" for k in range(40)]) for i in range(12)]
    got = decontam.contaminated(docs(texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.item_id, x.window_start, x.n_common, x.n_union) for x in got) == [
        (i, i, 40, 120, 156) for i in range(12)]


def test_matches_of_one_repeated_word_grow_in_proportion(spark, docs, monkeypatch):
    """A run of one word against an item of the same word: rows and windows double with both, no product."""
    from pyspark.sql import functions as F
    real, seen = decontam.staged, []

    def spy(df, name):
        out = real(df, name)
        if name == "hits":
            seen.append(out.agg(F.count("*"), F.sum(F.size("lays"))).first())
        return out

    monkeypatch.setattr(decontam, "staged", spy)
    for n in (50, 100):
        texts = [" ".join(["a"] * 4 * n), " ".join(["b"] + ["a"] * (n - 2) + ["b"]), "a a a a b a a a a a b"]
        items = [(1, " ".join(["a"] * n)), (2, "a a a a b a a a a a")]
        got = decontam.contaminated(docs(texts), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(x.doc_id, x.item_id) for x in got} == brute_contaminated(texts, items)
    (rows, lays), (rows2, lays2) = seen
    assert rows2 <= 2.2 * rows and lays2 <= 2.2 * lays
