"""Secret, personal-data and licence scans."""

import hashlib
import random
import re
import string
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import licences, pii, secrets
from termloom.llm import textkernel as tk
from tests.llm.fixtures import SCHEMA, WORD, awkward, clashing, table

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_pii(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["ToKeN", "ſecret", "api_key", "APIKEY", "pass", "word", "passwd", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ab", "é", "x.y/z", "=="]), max_size=14).map("".join))
def test_base_secrets(t):
    assert secrets.base_spans(t) == base_secrets(t)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b@", "@", "c.d", ".", "-", "%", "4111 1111 1111 1111", "4111-1111", "1.2.3.4", "256", "0007", "+", "49 (30) 123", "(", " ", "é", "1", "12345678"]), max_size=14).map("".join))
def test_base_personal_data(t):
    assert pii.base_spans(t) == base_pii(t)


def test_queries_join_spans_and_handle_awkward_rows(spark):
    extra = [(50_001, 'é token = "abcdef012345abcdef" AKIA' + "Q" * 16 + " mail me@x.org or +49 30 123456", "en", "a", 1)]
    rows = awkward() + extra * 2
    got = secrets.scan_secrets(clashing(table(spark, rows), "spans", "n_hex")).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, *_ in rows if i is not None}
    for r in got:
        if r.doc_id is not None:
            spans = base_secrets(text[r.doc_id])
            joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
            assert set(joined.split(",")) <= set(r.spans.split(","))
    got = pii.scan_pii(clashing(table(spark, rows), "spans", "row", "found")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(base_pii(text[r.doc_id])))
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            assert r.spans == joined
    for f in (secrets.scan_secrets, pii.scan_pii, licences.scan_licences):
        assert f(spark.createDataFrame([], SCHEMA)).count() == 0


def test_novelty_tells_random_strings_from_identifiers():
    r = random.Random(1)
    signs = string.ascii_letters + string.digits
    hits = 0
    for _ in range(200):
        token = "".join(r.choices(signs, k=r.randint(20, 48)))
        t = f"the value of the bearer credential: {token} and so on"
        spans = secrets.novel_spans(t, secrets.base_spans(t))
        hits += [t[a:b] for a, _, b in spans] == [token]
    assert hits >= 190
    for word in ("connection_string_for_database2", "your_secret_token_placeholder_123", "production_environment_variable_7", "auth_config_settings_value_list_2"):
        t = f"the auth setting {word} is read from the file"
        assert secrets.novel_spans(t, []) == []
    assert secrets.novel_spans("a random name " + "".join(r.choices(signs, k=30)), []) == []


def test_novel_values_beside_their_names():
    """Values in NAME=value, before a cue, and of letters or digits alone."""
    r = random.Random(9)
    signs = string.ascii_letters + string.digits
    forms = ["AWS_SECRET_ACCESS_KEY={}", "PRIVATE_KEY={}", "pwd={}", "auth={}", "https://x.example/?a=1&access_key={}&b=2", "x=auth={}", "credential: {}==", "PWD ={}", "the value {} is the token", "é: {}\nis the bearer"]
    hits = 0
    for k in range(200):
        t, form = "".join(r.choices(string.ascii_letters if k % 4 == 0 else signs, k=40)), forms[k % len(forms)]
        text = form.format(t)
        want = t + "==" if "{}==" in form else t
        hits += [text[a:b] for a, _, b in secrets.novel_spans(text, secrets.base_spans(text))] == [want]
    assert hits >= 190
    far = "".join(r.choices(signs, k=40))
    assert secrets.novel_spans(f"{far} {'la ' * 20} is the token", []) == []
    assert secrets.novel_spans("private_key=connection_string_for_database2", []) == []
    assert len(secrets.novel_spans("auth" * 200_000 + f" {far}", [])) == 1


def brute_novel(t, judge):
    """Every token against every cue and every base span, one after the other."""
    base, out = base_secrets(t), []
    cues = [m.span() for m in secrets._CUE.finditer(t)]
    for m in secrets._TOKEN.finditer(t):
        a, b = m.span()
        near = any(b > x - secrets.REACH and a < y + secrets.REACH for x, y in cues)
        if near and b - a >= secrets.LEAST and all(b <= x or y <= a for x, _, y in base) and judge.named(m[0]) < secrets.NAMED:
            if judge.novelty(m[0], t[max(0, a - secrets.AROUND) : a], t[b : b + secrets.AROUND]) >= secrets.NOVEL:
                out.append((a, 3, b))
    return out


def test_secrets_by_novelty_over_a_corpus(spark):
    """The dictionary comes from the corpus: its own identifiers are left alone, planted
    values that no base pattern knows are found, and both as the brute-force version has them."""
    from tests.llm.fixtures import prose

    r = random.Random(21)
    signs = string.ascii_letters + string.digits
    stems = ["".join(r.choices(string.ascii_lowercase, k=r.randint(6, 9))) for _ in range(60)]  # words of no language
    name = lambda: "_".join(r.choices(stems, k=3))
    forms = ["{n}:\n  private_key: '{v}'", 'Authorization: Bearer {v}', "pwd={v}", "auth {n} {v}", "AWS_SECRET_ACCESS_KEY={v}", "# {v} is the credential of {n}"]
    rows, want = [], {}
    for k in range(400):
        lines = [f"auth.{name()} = {name()}" for _ in range(6)] + [prose(r, 15)]
        if k % 4 == 0:
            v = "".join(r.choices(signs, k=r.randint(20, 44)))
            want[k] = v
            lines.insert(r.randrange(6), forms[k // 4 % len(forms)].format(n=name(), v=v))
        rows.append((k, "\n".join(lines), "en", "a", 1))
    words = secrets.learned_words(table(spark, rows))
    assert set(stems) <= set(words) and sum(len(w) + 1 for w in words) <= secrets.DICTIONARY_BYTES
    judge = secrets.Novelty(words)
    right = found = 0
    for x in secrets.scan_secrets(table(spark, rows)).collect():
        t = rows[x.doc_id][1]
        base = [(a, k, b) for a, k, b in base_secrets(t)]
        assert x.spans == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + brute_novel(t, judge)))
        spans = [t[int(a) : int(b)] for kind, a, b in (s.split(":") for s in x.spans.split(",") if s) if kind == "novel"]
        found += len(spans)
        right += want.get(x.doc_id) in spans
    print(f"recall {right / len(want):.3f}, precision {right / found:.3f}")
    assert right >= 0.95 * len(want) and right >= 0.95 * found
    # with no dictionary but the built-in names, the corpus' own identifiers look like secrets
    bare = secrets.Novelty()
    assert sum(len(brute_novel(t, bare)) for _, t, *_ in rows) > 2 * found


def test_spans_of_a_long_log_take_linear_time():
    line = "token = abcdef012345abcdef api_key=qqqqqqqqqqqq x.y@z.org 10.0.0.1 and so on\n"
    took = []
    for n in (2_000, 8_000):
        t = line * n
        began = time.process_time()
        spans = secrets.base_spans(t)
        secrets.novel_spans(t, spans)
        took.append(time.process_time() - began)
        assert len(spans) >= 2 * n
    assert took[1] < 8 * took[0] + 0.5


def test_bootstrapping_finds_unseen_identifiers(spark):
    """Contexts of valid cards reveal ill-formed ones; other contexts reveal nothing."""
    r = random.Random(2)

    def card(valid):
        while True:
            d = "".join(r.choices("0123456789", k=16))
            if luhn(d) == valid:
                return d

    rows = [(k, f"please charge customer card {card(True)} today {k}", "en", "a", 1) for k in range(40)]
    rows += [(100 + k, f"please charge customer card {card(False)} today", "en", "a", 1) for k in range(3)]
    rows += [(200 + k, f"the model number {card(False)} was sold", "en", "a", 1) for k in range(20)]
    got = {x.doc_id: x for x in pii.scan_pii(table(spark, rows)).collect()}
    for i, t, *_ in rows:
        m = re.search("[0-9]{16}", t)
        if i < 100:
            assert got[i].n_card == 1 and got[i].spans == f"card:{m.start()}:{m.end()}"
        elif i < 200:
            assert got[i].spans == f"found:{m.start()}:{m.end()}"
        else:
            assert got[i].spans == ""


def test_contexts_find_what_has_another_shape(spark):
    """Contexts of phones and emails reveal accounts, handles and names in their place."""
    r = random.Random(7)
    rows = [(k, f"{r.choice('abcdef')} you may always ring the owner on +1 ({r.randint(100, 999)}) 555-{k:04d} after lunch", "en", "a", 1) for k in range(40)]
    rows += [(100 + k, f"the reply goes to user{k}x@mail{k}.example.com before noon", "en", "a", 1) for k in range(40)]
    odd = [("ring the owner on {} after lunch", v) for v in ("004930 123 4567", "DE44 5001 0517 5407 3249 31")] + [("the reply goes to {} before noon", v) for v in ("@kalomi_77", "Ada Lovelace", "Zoë")]
    rows += [(200 + k, "é " + t.format(v), "en", "a", 1) for k, (t, v) in enumerate(odd)]
    rows += [(300 + k, f"the parcel went on {k} other way home", "en", "a", 1) for k in range(10)]
    text = {i: t for i, t, *_ in rows}
    for x in pii.scan_pii(table(spark, rows)).collect():
        if x.doc_id < 200:
            assert x.n_found == 0 and x.n_phone + x.n_email == 1
        elif x.doc_id < 300:
            v = odd[x.doc_id - 200][1]
            a = text[x.doc_id].index(v)
            assert x.spans == f"found:{a}:{a + len(v)}"
        else:
            assert x.spans == ""


def test_bootstrapping_takes_a_second_hop(spark):
    """Accounts found beside phones reveal the accounts of a context that holds no seed."""
    r = random.Random(8)
    accounts = [f"KX-{r.randint(10**7, 10**8 - 1)}" for _ in range(20)]
    rows = [(k, f"you may ring the owner on +1 ({r.randint(100, 999)}) 555-{k:04d} after lunch", "en", "a", 1) for k in range(90)]
    rows += [(100 + k, f"you may ring the owner on {a} after lunch", "en", "a", 1) for k, a in enumerate(accounts)]
    rows += [(200 + k, f"the money left account {a} again today", "en", "a", 1) for k, a in enumerate(accounts)]
    rows += [(300, "the money left account QQ-7755 again today", "en", "a", 1), (301, "the money stayed in QQ-7755 for days", "en", "a", 1)]
    got = {x.doc_id: x.spans for x in pii.scan_pii(table(spark, rows)).collect()}
    for i, t, *_ in rows[90:-1]:
        a, b = re.search("[A-Z]{2}-[0-9]+", t).span()
        assert got[i] == f"found:{a}:{b}"
    assert got[301] == ""
    one = {x.doc_id: x.spans for x in pii.scan_pii(table(spark, rows), turns=1).collect()}
    assert one[100] and not one[300]


CORPUS_NOTICES = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "All rights reserved."]


def test_licence_model_on_held_out_frames_and_families():
    m = licences.trained()
    texts, *_ = licences._variants(7)
    assert not any(n in t for t in texts for n in CORPUS_NOTICES[:4]) and CORPUS_NOTICES[4] not in texts
    by = licences.held_out_frames()
    print("held-out frames", m.accuracy, by)
    assert m.accuracy > 0.84 and by["none"] > 0.98
    z, y = licences._held_out(7, 80)
    p = licences._probabilities(z, m.temperature)
    best, sure = p.argmax(1), p.max(1)
    bins = np.minimum((sure * 10).astype(int), 9)
    error = sum(abs(((best == y) - sure)[bins == k].sum()) for k in range(10)) / len(y)
    print("expected calibration error", error)
    assert error < 0.06
    families = licences.held_out_families()
    print("held-out families", families)
    assert sum(families.values()) / len(families) > 0.88


def brute_notices(m, text):
    """The scan of one text with dictionaries and loops: (first line, lines, family, probability)."""
    trim = ".,;:!?\"'()[]{}<>*#`/-_"
    mask = (1 << 64) - 1

    def word_hash(w):
        import pyarrow as pa

        data, offsets = tk.flatten(pa.array([w]))
        return int(tk.range_hashes(data, offsets[:-1], offsets[1:], True)[0])

    def mix(x):
        return int(tk.mix(np.array([x & mask], np.uint64))[0])

    def words(t):
        out = []
        for w in WORD.findall(t):
            for _ in range(4):
                w = w[1:] if w and w[0] in trim else w
            for _ in range(4):
                w = w[:-1] if w and w[-1] in trim else w
            out += [word_hash(w)] * bool(w)
        return out

    weights = {int(f): m.weights[k].astype(float) for k, f in enumerate(m.features)}

    def probabilities(h):
        grams = {mix(x + 1) for x in h}
        for size in (2, 3):
            for k in range(len(h) - size + 1):
                x = size
                for y in h[k : k + size]:
                    x = mix(x * 0x9FB21C651E98DF25 + y)
                grams.add(x)
        z = sum((weights[g] for g in sorted(grams) if g in weights), np.zeros(len(licences.CLASSES))) / max(len(h), 4) ** 0.5 + m.bias
        e = np.exp((z - z.max()) / m.temperature)
        return e / e.sum()

    def verdict(p, t):
        best = int(p[:-1].argmax())
        family = licences.CLASSES[best]
        if best < len(licences.BODIES):
            pairs = {tuple(x) for x in zip(words(t), words(t)[1:])}
            scores = []
            for own in (*licences.BODIES[family], *licences.NAMES[family], *licences.IDS[family]):
                theirs = {tuple(x) for x in zip(words(own), words(own)[1:])}
                if len(words(own)) == 1:
                    theirs = set()
                scores.append(len(pairs & theirs) / max(1, min(len(pairs), len(theirs))))
            if p[best] < m.threshold or max(scores) < licences.SHARED:
                family = "unknown"
        return family, float(1 - p[-1] if family == "unknown" else p[best])

    lines = text.split("\n")
    h = [words(x) for x in lines]
    alone = [probabilities(x) for x in h]
    out, done, k = [], set(), 0
    while k < len(lines):
        y = k
        while y + 1 < len(lines) and h[y] and h[y + 1] and licences.WRAPPED[0] <= len(lines[y].encode()) <= licences.WRAPPED[1]:
            y += 1
        if y > k:
            p = probabilities(sum(h[k : y + 1], []))
            a, b = k, y
            while a < b and alone[a][-1] >= 0.5:
                a += 1
            while a < b and alone[b][-1] >= 0.5:
                b -= 1
            if p[-1] < 0.5 and a < b:
                family, sure = verdict(p, "\n".join(lines[a : b + 1]))
                if family != "unknown":
                    out.append((a, b - a + 1, family, sure))
                    done |= set(range(a, b + 1))
        k = y + 1
    for k, p in enumerate(alone):
        if p[-1] < 0.5 and h[k] and k not in done:
            out.append((k, 1, *verdict(p, lines[k])))
    return sorted(out)


WRAPPED_NOTICE = """/*
 * This library is free software; you can redistribute it and/or modify it
 * under the terms of the GNU Lesser General Public License as published by the
 * Free Software Foundation; either version 2.1 of the License, or (at your
 * option) any later version.
 *
 * Nothing else is said here.
 */
int main() { return 0; }"""


def test_licences_match_the_brute_force_scorer(spark):
    from tests.llm.fixtures import prose

    r = random.Random(31)
    m = licences.trained()
    texts = [t for t in licences._variants(5)[0][::40]] + CORPUS_NOTICES + [WRAPPED_NOTICE]
    texts += ["\n".join([prose(r, 12), r.choice(CORPUS_NOTICES), prose(r, 8), "", "-- ** --", prose(r, 3)]) for _ in range(20)]
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(texts)]
    rows += [rows[3], (None, CORPUS_NOTICES[0], None, None, None)]
    got = {}
    for x in licences.scan_licences(table(spark, rows)).collect():
        got.setdefault(x.doc_id, []).append((x.line, x.n_lines, x.family, x.probability))
    assert got.pop(None) == [(0, 1, "mit", got[texts.index(CORPUS_NOTICES[0])][0][3])]
    for i, t, *_ in rows[: len(texts)]:
        want = brute_notices(m, t)
        have = sorted(got.get(i, []))
        if i == 3:
            assert have == sorted(have[::2] * 2)  # a repeated row is scanned again
            have = have[::2]
        assert [x[:3] for x in have] == [x[:3] for x in want], t
        assert all(abs(x[3] - y[3]) < 1e-3 for x, y in zip(have, want))
    wrapped = got[texts.index(WRAPPED_NOTICE)]
    assert wrapped == [(1, 4, "lgpl", wrapped[0][3])]


def test_licences_in_documents(spark):
    r = random.Random(5)
    from tests.llm.fixtures import prose

    known = [("mit", "Released under the MIT License."), ("apache-2.0", "Licensed under the Apache License, Version 2.0."), ("gpl", "This work is licensed under the GNU General Public License, version 3."), ("cc-by-nc", "Licensed under CC BY-NC 4.0."), ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."), ("unknown", "Released under the Kalomi License.")]
    rows = [(k, f"{prose(r, 30)}é\n{t}\n{prose(r, 20)}", "en", "a", 1) for k, (_, t) in enumerate(known)]
    rows += [(100 + k, prose(r, 50) + "\nHe lost his driver's license in town.", "en", "a", 1) for k in range(5)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, "Orre " * 9000, "en", "a", 1)]
    got = licences.scan_licences(clashing(table(spark, rows), "line", "family")).collect()
    assert {(x.doc_id, x.family) for x in got} == {(k, f) for k, (f, _) in enumerate(known)}
    text = {i: t for i, t, *_ in rows}
    for x in got:
        assert text[x.doc_id][x.start : x.end] == known[x.doc_id][1] and x.line == 1
