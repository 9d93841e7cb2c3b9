"""Pair operators and lookups of the corpus subpackage against brute force on small tables."""
import hashlib
import itertools
import random

import pytest

from clustrum.llm import decontaminate, jaccard, spotsigs, urls

SCHEMA = "doc_id long, text string, set_id string, token int, host string"


def docs_of(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "h") for i, t in rows], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(seed=5):
    """Texts with exact copies, near copies around the threshold, a passage in many, short, empty and null texts."""
    rng = random.Random(seed)
    passage = prose(rng, 30)
    rows, bases = [], [prose(rng, rng.randrange(20, 90)) for _ in range(12)]
    for base in bases:
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(50)}"
            rows.append(" ".join(words))
    rows += [" ".join(prose(rng, 15) + passage + prose(rng, 10)) for _ in range(12)]
    rows += ["One two", "one  TWO", "one", "", None, " \t\n", "a b c d e", "a b c d e f", "é É", "É é"]
    rows += [" ".join(prose(rng, 5000, 5000))] * 2
    rng.shuffle(rows)
    return [(i * 3 % 101, t) for i, t in enumerate(rows)]


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    k = min(size, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute_classes(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    out = []
    for at, (doc_id, _) in enumerate(rows):
        members = [rows[b][0] for b in range(len(rows)) if find(b) == find(at) and rows[b][0] is not None]
        own = doc_id if not sets[at] else (min(members) if members else None)
        out.append((doc_id, len(sets[at]), own))
    return out


def by_repr(rows):
    return sorted(map(tuple, rows), key=repr)


def test_rounds_move_one_row_a_group_and_few_pairs_meet(spark, monkeypatch):
    rows, written = near_copies(), {}
    write = jaccard.materialize

    def recorded(df, name):
        written.setdefault(name, []).append(write(df, name))
        return written[name][-1]

    monkeypatch.setattr(jaccard, "materialize", recorded)
    got = jaccard.near_duplicate_classes(docs_of(spark, rows))
    assert by_repr(got.collect()) == by_repr(brute_classes(rows))
    for packed in written["open"]:
        assert packed.count() == packed.select("g").distinct().count()
    groups = written["spans"][-1].count()
    assert written["met"][0].count() <= groups
    # Shingles that one component has to itself are given up for good.
    held = [packed.selectExpr("coalesce(sum(size(postings)), 0)").first()[0] for packed in written["open"]]
    assert held == sorted(held, reverse=True) and held[0] > held[-1]


def test_jaccard_classes_match_all_pairs(spark):
    rows = near_copies() + [(None, "a b c d e"), (7, None), (7, "one"), (7, "one")]
    got = jaccard.near_duplicate_classes(docs_of(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert by_repr(got.collect()) == by_repr(brute_classes(rows))


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(2)
    base = prose(rng, 60, 10_000)
    rows = []
    for i in range(150):
        words = list(base)
        words[rng.randrange(60)] = f"changed{i}"
        rows.append((i, " ".join(words)))
    got = by_repr(jaccard.near_duplicate_classes(docs_of(spark, rows)).collect())
    assert got == by_repr(brute_classes(rows))


def test_keep_first_keeps_one_row_of_each_class(spark):
    rows = near_copies(9) + [(500, "left alone here it is"), (500, "left alone here it is"), (501, None), (501, None), (501, "")]
    kept = jaccard.keep_first(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "set_id", "token", "host"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    classes = brute_classes(rows)
    expected, done = [], set()
    for (doc_id, text), (_, n, component) in sorted(zip(rows, classes), key=lambda x: hashlib.md5((x[0][1] or "").encode()).digest()):
        if n == 0 or (doc_id == component and component not in done):
            expected.append((doc_id, text))
            done.add(component if n else None)
    assert got == sorted(expected, key=repr)
    assert jaccard.keep_first(empty_docs(spark)).count() == 0


def test_keep_first_tells_classes_of_one_id_apart(spark):
    copies = " ".join(f"w{i}" for i in range(40))
    rows = [(None, "one text without an id here"), (None, "quite another one that has none"), (None, "quite another one that has none"),
            (7, "first text of a repeated id"), (7, "its second text is no copy"), (8, "its second text is no copy"),
            (9, copies), (None, copies + " more"), (9, copies + " other")]
    got = {(r.doc_id, r.text): r for r in jaccard.keep_first(docs_of(spark, rows)).collect()}
    ninth = min((copies, copies + " other"), key=lambda t: hashlib.md5(t.encode()).digest())
    assert sorted(got, key=repr) == sorted({rows[0], rows[1], rows[3], rows[4], (9, ninth)}, key=repr)
    assert jaccard.keep_first(docs_of(spark, rows)).count() == 5


def words_of(text):
    return decontaminate.words_of((text or "").encode())


def brute_contamination(rows, items):
    out = []
    for doc_id, text in rows:
        words, hit, found = words_of(text), set(), set()
        for item_id, item in items:
            w = words_of(item)
            n = min(10, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                for j in range(len(words) - n + 1):
                    if words[j:j + n] == w[i:i + n]:
                        hit |= set(range(j, j + n))
                        found.add(item_id)
        ids = ",".join(sorted(str(i) for i in found if i is not None)).encode()
        out.append((doc_id, len(words), len(hit), len({i for i in found if i is not None}), hashlib.sha256(ids).hexdigest(), bool(hit)))
    return out


def benchmark_case():
    rng = random.Random(3)
    items = [(i, " ".join(prose(rng, rng.randrange(8, 40), 3000))) for i in range(12)]
    items += [(90, "Only Three-words, é"), (91, "one"), (92, ""), (93, None), (None, "null item id of a few words"), (10, items[0][1]), (94, items[1][1])]
    items += [(95, " ".join(["again"] * 14))]
    rows = []
    for i in range(40):
        words = prose(rng, rng.randrange(0, 120), 3000)
        passage = words_of(rng.choice(items[:12])[1])
        cut = [w.decode() for w in passage[rng.randrange(4):rng.randrange(5, 40)]]
        at = rng.randrange(len(words) + 1)
        rows.append((i, "  ".join(words[:at] + cut + words[at:])))
    rows += [(50, "Only three words É é"), (51, "only THREE words; é!"), (52, None), (53, ""), (None, items[0][1]), (54, "again " * 40),
             (54, "again " * 40), (54, "one"), (55, "null item id of a few words")]
    return rows, items


def test_contamination_matches_a_search_of_all_places(spark):
    rows, items = benchmark_case()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs_of(spark, rows), benchmark).drop("text_key")
    assert by_repr(got.collect()) == by_repr(brute_contamination(rows, items))
    kept = decontaminate.drop_contaminated(docs_of(spark, rows), benchmark)
    clean = [row for row, found in zip(rows, brute_contamination(rows, items)) if not found[-1]]
    assert by_repr((r.doc_id, r.text) for r in kept.collect()) == by_repr(clean)
    assert kept.columns == ["doc_id", "text", "set_id", "token", "host"]


def test_contamination_of_empty_tables(spark):
    rows, items = benchmark_case()
    nothing = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(docs_of(spark, rows[:3]), nothing).collect()
    assert [r.n_hit for r in got] == [0, 0, 0]
    assert decontaminate.contamination(empty_docs(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def spot_rows():
    rng = random.Random(11)
    common = ["the", "of", "and", "is"]
    rows = [(i, " ".join(rng.choice(common) if rng.random() < .3 else f"w{rng.randrange(90)}" for _ in range(rng.randrange(0, 60)))) for i in range(57)]
    copies = [(100 + i, t.replace("w3", "w4", 1)) for i, t in rows[:20]]
    return rows + copies + [(200, None), (201, ""), (202, "no anchors whatever here"), (203, "the"), (None, "null id of it"), (30, "second row of this id")]


@pytest.mark.parametrize("range_rows", [5, 1000])
def test_every_row_finds_its_successor(spark, range_rows):
    rows = spot_rows()
    got = spotsigs.fingerprint_edits(docs_of(spark, rows), range_rows=range_rows).collect()
    assert len(got) == len(rows)
    unique = [r for r in rows if r[0] is not None and r[0] != 30]
    order = sorted(unique, key=lambda r: -r[0])
    by_id = {r.doc_id: r for r in got}
    for (doc_id, text), (next_id, following) in zip(order, order[1:]):
        if doc_id > 30 and next_id < 30 or next_id == 30:
            continue
        text, following, row = text or "", following or "", by_id[doc_id]
        changed = text[:len(text) - len(text) // 3] + following[:len(text) // 3]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        own, edited, later = (spotsigs.signature_set(t) for t in (text, changed, following))
        assert (row.fingerprint, row.edited_fingerprint) == (spotsigs.to_text(own), spotsigs.to_text(edited))
        assert row.near_edited == spotsigs.pruned_jaccard(own, edited) and row.near_next == spotsigs.pruned_jaccard(own, later)
    # Null ids come last and are followed by the first row.
    last, first = by_id[None], order[0][1] or ""
    cut = len("null id of it") // 3
    assert last.edited_sha256 == hashlib.sha256(("null id of it"[:-cut] + first[:cut]).encode()).hexdigest()


def test_successor_of_a_single_row_and_of_null_ids_only(spark):
    row = spotsigs.fingerprint_edits(docs_of(spark, [(1, "the one two three")])).first()
    assert row.near_next == 1.0 and row.n_chars == 17
    assert spotsigs.fingerprint_edits(docs_of(spark, [(None, "the a"), (None, None), (None, "the a")])).count() == 3
    assert spotsigs.fingerprint_edits(empty_docs(spark)).count() == 0


def naive_signatures(text):
    words = (text or "").lower().encode().translate(spotsigs._SEPARATORS).split()
    anchors = {a.encode() for a in spotsigs.ANCHORS}
    out = set()
    for at, word in enumerate(words):
        chain = [w for w in words[at + 1:] if w not in anchors][:spotsigs.CHAIN_WORDS]
        if word in anchors and len(chain) == spotsigs.CHAIN_WORDS:
            out.add((word, *chain))
    return out


def test_signatures_are_chains_after_anchors():
    for _, text in spot_rows():
        naive = naive_signatures(text)
        assert len(spotsigs.signature_set(text)) == (len(naive) or bool((text or "").strip()))


def test_similar_prints_match_all_pairs(spark):
    prints = {}
    rows = [(i, spotsigs.to_text(spotsigs.signature_set(t))) for i, (_, t) in enumerate(spot_rows())]
    pairs, members = spotsigs.similar_pairs(spark.createDataFrame(rows + [(900, None)], "doc_id long, fingerprint string"), 0.6)
    for _, f in rows:
        prints[hashlib.sha256(f.encode()).hexdigest()] = {f[i:i + 12] for i in range(0, len(f), 12)}
    expected = {}
    for (a, x), (b, y) in itertools.combinations(sorted(prints.items()), 2):
        if x and y and len(x & y) >= 0.6 * len(x | y) - 1e-12:
            expected[frozenset((a, b))] = len(x & y) / len(x | y)
    got = {frozenset((r.a, r.b)): r.likeness for r in pairs.collect()}
    assert got == pytest.approx(expected) and len(expected) >= 3
    assert members.count() == len(rows) + 1 and members.where("class IS NULL").count() == 1 + sum(not f for _, f in rows)


def test_urls_match_every_rule(spark):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.net/en", "block"), ("a.b.example.net/", "allow"), ("org", "block"),
             ("dup.com/x", "allow"), ("dup.com/x", "block"), (None, "block"), ("/nohost", "block"), ("EXAMPLE.de/De", "block")]
    hosts = ["net", "example.net", "a.b.example.net", "b.example.net", "notexample.net", "org", "x.org.", "dup.com", "EXAMPLE.DE", "", "é.net", "a..net"]
    paths = ["", "/", "/en", "/en/", "/english", "/en/x?y://z", "#f", "?q=/en/", "/x", "/De/1", "/de/1"]
    cases = [f"{s}{h}{p}" for s in ("http://", "x", "://", "http://u://") for h in hosts for p in paths] + [None, "", "http://net/" + "a" * 30_000]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases + cases[:9])], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "rule string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, table).collect()}
    lower = str.maketrans(urls.UPPER, urls.LOWER)
    known = {}
    for rule, verdict in rules:
        if rule and rule.partition("/")[0]:
            host, slash, path = rule.partition("/")
            key = (host.translate(lower), slash + path)
            known[key] = max(known.get(key, ""), verdict)
    for at, url in enumerate(cases + cases[:9]):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = rest[:end].translate(lower), rest[end:]
            path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(len(h + p), h + p, v) for (h, p), v in known.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert got[at] == (host, path, best[1], best[2]), url
    none = urls.judge_urls(pages, spark.createDataFrame([], "rule string, verdict string"))
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), table).count() == 0
