"""Personal data: strict spans and the graph by brute force, planted disguises, awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import AWKWARD, WORDS

from skyframe.llm.common import save
from skyframe.llm.pii import KINDS, OTHER, _patterns, base_spans, bootstrap, extract, find_personal_data, loose_spans, occurrences, tokens

BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    def good(kind, m):
        digits = [int(d) for d in re.sub("[^0-9]", "", m)]
        if kind == 1:
            return all(int(p) <= 255 for p in m.split("."))
        if kind == 2:
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and luhn % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(BASE) for m in re.finditer(p, text) if good(k, m[0]))


def test_base_spans():
    texts = [d[1] or "" for d in AWKWARD] + [
        "a@b@c.d a@@b.c @x.y +a.b@c.d.e. x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.004", "4111 1111-1111 1111 4111111111111112 0-0-0-0-0-0-0-0-0-0-0-0",
        "+1 (675) 555-2357 ++44 20 7946 0958. +1 2", "é +49.30.901820 ünï ann@exämple.com bob@mail.example.com",
    ]
    for t in texts:
        assert base_spans(t) == brute_spans(t), t[:50]
    # Work is linear in long runs, on which the patterns above would take minutes.
    assert base_spans("1" * 300_000) == [] and base_spans("1" * 300_000 + ".1.2.3 5.6.7.8") == [(300_007, 1, 300_014)]


def told(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_contexts():
    text = "so e-mail:ann@x.org, or 555 (home)"
    assert _patterns(text, 10, 19) == ["<:", "<mail :", "<- mail :", ">,", ">, or"]
    long = "w" * 5000 + " : " + " " * 300 + "a@b.c" + " " * 500 + "z"
    at = long.index("a@b.c")
    assert _patterns(long, at, at + 5) == ["<:", "<" + "w" * 5000 + " :", ">z"]
    assert tokens("Tel. 030/12") == ["tel", ".", "000", "/", "00"]


def test_loose_forms():
    cases = {
        "ann {at} x {dot} org": (0, "ann {at} x {dot} org"), "ann_at_x_dot_org": (0, "ann_at_x_dot_org"), "ANN AT X DOT ORG": (0, "ANN AT X DOT ORG"), "10[.]0[.]0[.]7": (1, "10[.]0[.]0[.]7"),
        "(555) 010-9999": (3, "(555) 010-9999"), "4111-1111/1111-1112": (2, "4111-1111/1111-1112"), "XX-4821-9930": (OTHER, "XX-4821-9930"), "look at that": None, "in 2024 we": None,
    }
    for text, want in cases.items():
        got = [(k, text[a:b]) for k, a, b in loose_spans(text, base_spans(text))]
        assert got == ([want] if want else []), text
    assert list(loose_spans("k" * 300_000 + " " + "9" * 200_000, []))[-1][1:] == (300_001, 500_001)


def test_occurrences_against_a_loop(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b:", "c", "d1", "."]) for _ in range(60)) for _ in range(40)] + [None, ""]
    want = Counter()
    for t in texts:
        own = tokens(t or "")
        for k in (1, 2, 3):
            want.update(" ".join(own[i : i + k]) for i in range(len(own) - k + 1))
    grams = rng.sample(sorted(want), 30)
    table = save(spark.createDataFrame([(g,) for g in [*grams, "never there"]], "gram string"), "grams")
    assert {r.gram: r.total for r in occurrences(told(spark, texts), table).collect()} == {g: want[g] for g in grams}


def brute_graph(texts, support, confidence, rounds):
    links, seed = Counter(), set()
    for t in texts:
        base = base_spans(t)
        for form, a, b, s in [(k, a, b, True) for a, k, b in base] + [(k, a, b, False) for k, a, b in loose_spans(t, base)]:
            if s:
                seed.add((form, t[a:b].lower()))
            for p in _patterns(t, a, b):
                links[form, p, t[a:b].lower()] += 1
    total = Counter()
    for t in texts:
        own = tokens(t)
        for k in (1, 2, 3):
            total.update(" ".join(own[i : i + k]) for i in range(len(own) - k + 1))
    instances = Counter((f, p) for f, p, _ in links if f != OTHER)
    strong = {k for k, n in instances.items() if n >= support}
    graph = [(k, f, p, i, n) for (f, p, i), n in links.items() for k in range(4) if (k, p) in strong and f in (k, OTHER)]
    belief, found = {(k, f, i): 1.0 for k, f, _, i, _ in graph if (f, i) in seed}, {}
    seeds = dict(belief)
    for _ in range(rounds):
        top, below = Counter(), Counter()
        for k, f, p, i, n in graph:
            top[k, p] += belief.get((k, f, i), 0) * n
            below[k, p] += n
        trust = {x: top[x] / (max(below[x], total[x[1][1:]]) + 1) for x in below}
        by = defaultdict(list)
        for k, f, p, i, _ in graph:
            if (k, f, i) not in seeds:
                by[k, f, i].append(trust[k, p])
        belief = seeds | {x: 1 - math.prod(max(1 - t, 1e-9) for t in ts) for x, ts in by.items()}
        found = {x: max(ts) for x, ts in by.items() if max(ts) >= confidence and belief[x] >= confidence}
    out = {}
    for (k, f, i), t in found.items():
        out[f, i] = max(out.get((f, i), (0, 0, -9)), (t, belief[k, f, i], -k))
    return {x: -v[2] for x, v in out.items()}


def corpus(rng):
    """Documents with seeds behind and before phrases, disguises in the same places, and as many look-alikes elsewhere."""
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, hidden = [], {}
    for i in range(240):
        kind = i % 6
        plain = [f"email:{name()}@{name()}.org", f"call me under +1 ({number(3)}) 555-{number(4)}", f"my server is {rng.randrange(256)}.{rng.randrange(256)}.1.{rng.randrange(256)}", f"{name()}@{name()}.net is where i read"][i // 6 % 4]
        cases = [(f"email:{name()} (at) {name()} (dot) org", 6, 0), (f"call me under ({number(3)}) 555-{number(4)}", 14, 3), (f"my server is {number(2)}[.]{number(2)}[.]1[.]{number(2)}", 13, 1), (f"call me under EXT-{number(4)}-{number(3)}", 14, 3)]
        disguise, at, k = cases[i // 6 % 4]
        look = [f"the year {number(4)} {number(3)} {number(4)}", f"order {number(12)}", f"see part AB-{number(5)}-X", f"room ({number(3)}) {number(3)}-{number(4)}"][i // 6 % 4]
        start = words(12) + " "
        texts.append(f"{start}{disguise if kind == 4 else look if kind == 5 else plain} {words(9)}")
        if kind == 4:
            hidden[i] = f"{KINDS[k]}:{len(start) + at}:{len(start) + len(disguise)}"
    return texts, hidden


def test_planted_disguises_and_the_graph_by_brute_force(spark):
    texts, hidden = corpus(random.Random(11))
    docs = save(told(spark, texts), "docs")
    rows = {r.doc_id: r for r in find_personal_data(docs).collect()}
    added = {i: set(r.spans.split(",")) - set(r.base.split(",")) for i, r in rows.items() if r.spans != r.base}
    recall = sum(h in added.get(i, ()) for i, h in hidden.items()) / len(hidden)
    print("recall", recall, "spans added", sum(map(len, added.values())))
    assert recall >= 0.9 and sum(map(len, added.values())) <= 1.1 * len(hidden)
    got = {(r.form, r.instance): r.kind for r in bootstrap(docs, save(extract(docs), "seen")).collect()}
    assert got == brute_graph(texts, 5, 0.8, 3) and len(got) > 20


def test_bootstrapping_finds_what_patterns_introduce(spark, awkward, no_docs):
    known = [f"so my number is +1 (555) 010-{i:04d} thanks" for i in range(8)] + [f"email:user{i}@mail.org" for i in range(20)]
    new = ["so my number is (555) 010-9999 thanks", "they paid 1234 5678 90 there", "the year is 2024 12 05 here", "email:ann {at} mail {dot} org", "email:x@y.z"]
    rows = {r.doc_id: r for r in find_personal_data(told(spark, known + new)).collect()}
    assert rows[28].base == "" and rows[28].spans == "phone:16:30"
    assert rows[29].spans == rows[30].spans == "" and rows[3].spans == rows[3].base == "phone:16:33"
    assert rows[31].base == "" and rows[31].spans == "email:6:29" and rows[32].spans == rows[32].base == "email:6:11"
    renamed = awkward.withColumnsRenamed({"slot": "form", "word": "seen", "x": "kind", "score": "pattern"})
    assert find_personal_data(renamed).count() == len(AWKWARD) and find_personal_data(no_docs).count() == 0
