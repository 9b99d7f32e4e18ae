import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from axisloom.llm import private_data, secrets
from tests.llm.helpers import awkward, documents, empty, invented

PII = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(value):
    d = [int(c) for c in value if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def brute_private(text):
    found = []
    for k, pattern in enumerate(PII):
        for m in pattern.finditer(text or ""):
            n = sum(c in "0123456789" for c in m[0])
            good = (True, all(int(p) <= 255 for p in m[0].split(".")) if k == 1 else True, 12 <= n <= 19 and luhn(m[0]) if k == 2 else True, 9 <= n <= 15)[k]
            if good:
                found.append((m.start(), k, m.end()))
    return ",".join(f"{private_data.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_private_base_spans_against_plain_patterns(spark):
    alphabet = ["a", "b@", "c.d", "1", "23", "+1", " ", "-", "(", ")", ".", "@", "4111111111111111", "1.2.3.4", "é", "😀", "\ue000", "_x", "255", "x@y.zz", "00", "\n"]
    rows = list(enumerate(invented(5, 1500, alphabet)))
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", private_data.listed(private_data.base_spans(F.col("text"))).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in got} == {i: brute_private(t) for i, t in rows}


def test_private_long_runs_need_no_backtracking(spark):
    rows = list(enumerate(["a" * 100_000, "1 " * 50_000, "1." * 20_000, "+1" + "(" * 50_000, "@" * 10_000]))
    assert spark.createDataFrame(rows, "doc_id long, text string").select(F.size(private_data.base_spans(F.col("text")))).count() == 5


def test_private_digest_on_documents(spark):
    docs = documents(spark, 300)
    want = {r["doc_id"]: hashlib.sha256(brute_private(r["text"]).encode()).hexdigest() for r in docs.collect()}
    assert {r["doc_id"]: r["base_sha256"] for r in private_data.digest(docs).collect()} == want


def test_revealing_terms_are_found_beside_their_entity_only(spark):
    rng = random.Random(2)
    common = [f"plain{i}" for i in range(30)]
    rows = []
    for i in range(60):
        around = [rng.choice(common) for _ in range(12)]
        if i % 6 == 0:
            around[6:7] = ["Zorblax", "z@secret.example"]
        rows.append((i, " ".join(around) + f" end{i}"))
    got = {r["doc_id"]: r for r in private_data.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        at = text.find("Zorblax")
        assert (f"removed:{at}:{at + 7}" in got[i]["spans"].split(",")) == (i % 6 == 0)
        assert got[i]["n_removed"] == (i % 6 == 0)
        if i % 6:
            assert got[i]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in private_data.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Zorblax" not in clean[0]
    assert "<EMAIL>" in clean[0]
    assert clean[1] == rows[1][1]


def brute_shares(rows, words, support):
    """{(entity, term): share} from plain loops over whole texts."""
    near, terms_of, n_term, n_entity, total = Counter(), defaultdict(set), Counter(), Counter(), 0
    for i, text in rows:
        total += len(re.sub(r"[^\W_]+", "", text)) + 1
        n_term.update(w for w in re.split(r"[\W_]+", text.lower()) if len(w) >= 3)
        base = [(int(a), int(b), private_data.KINDS.index(k)) for k, a, b in (x.split(":") for x in brute_private(text).split(",") if x)]
        terms = [m for m in re.finditer(r"[^\W_]{3,}", text) if not any(a < m.end() and m.start() < b for a, b, _ in base)]
        for a, b, k in base:
            value = re.sub("[^0-9]", "", text[a:b]) if k > 1 else text[a:b].lower()
            before, after = [m for m in terms if m.start() < a][-words:], [m for m in terms if m.start() >= a][:words]
            around = [m[0].lower() for m in before + after]
            n_entity[f"{k}:{value}"] += 1
            for w in around:
                near[f"{k}:{value}", w] += 1
                terms_of[f"{k}:{value}", w].add(tuple(sorted(around)))
    out = {}
    for (e, w), n in near.items():
        if len(terms_of[e, w]) >= support:
            out[e, w] = math.log2(min(n, n_term[w]) * total / (n_entity[e] * n_term[w])) / -math.log2(n_entity[e] / total)
    return out


def brute_backed_off(rows, words, support, strength):
    """{(entity, term): share} from plain loops: chances from kind to class to entity."""
    near, seen, n_term, size, total, pairs = Counter(), defaultdict(set), Counter(), Counter(), 0, set()
    for _, text in rows:
        total += len(re.sub(r"[^\W_]+", "", text)) + 1
        n_term.update(w for w in re.split(r"[\W_]+", text.lower()) if len(w) >= 3)
        base = [(int(a), int(b), private_data.KINDS.index(k)) for k, a, b in (x.split(":") for x in brute_private(text).split(",") if x)]
        terms = [m for m in re.finditer(r"[^\W_]{3,}", text) if not any(a < m.end() and m.start() < b for a, b, _ in base)]
        for a, b, k in base:
            value = re.sub("[^0-9]", "", text[a:b]) if k > 1 else text[a:b].lower()
            of = [value.partition("@")[2], value.rpartition(".")[0], value[:6], value[:3]][k]
            three = (f"{k}:{value}", f"{k}/{of}", str(k))
            around = [m[0].lower() for m in [m for m in terms if m.start() < a][-words:] + [m for m in terms if m.start() >= a][:words]]
            size.update(three)
            for w in around:
                pairs.add((three, w))
                for key in three:
                    near[key, w] += 1
                    seen[key, w].add(tuple(sorted(around)))
    out = {}
    for three, w in pairs:
        chance, above = None, None
        for key in reversed(three):
            prior = size[key] / total if chance is None else chance * size[key] / size[above]
            enough = len(seen[key, w]) >= support
            chance, above = (min(near[key, w], n_term[w]) + strength * prior) / (n_term[w] + strength) if enough else prior, key
        own = size[three[0]] / total
        out[three[0], w] = math.log2(chance / own) / -math.log2(own)
    return out


def test_backed_off_shares_against_plain_counts(spark):
    rng = random.Random(16)
    mails = [f"m{i}@{h}.example" for i in range(12) for h in ("one", "two")]
    parts = [f"plain{i}" for i in range(20)] * 4 + mails + [f"+1 (212) 555-01{i:02d}" for i in range(20)] + [f"10.0.{i % 3}.{i}" for i in range(20)] + ["Ünïcode"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words, support, strength in ((5, 2, 1.0), (2, 3, 4.0)):
        got = {(r["entity"], r["term"]): r["share"] for r in private_data.evidence(docs, words, support, strength)[3].collect()}
        want = brute_backed_off(rows, words, support, strength)
        assert got.keys() == want.keys()
        assert len(got) > 200
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)


def test_terms_of_a_class_are_found_beside_entities_that_occur_once(spark):
    """A word that stands beside the addresses of one small domain alone is generalised; common words are left alone."""
    rng = random.Random(5)
    common = [f"plain{i}" for i in range(30)]
    rows = []
    for i in range(400):
        around = [rng.choice(common) for _ in range(60)]
        if i < 6:
            around[30:31] = ["Quuxworks", f"person{i}@quux.example"]
        elif i % 4 == 0:
            around[30] = f"person{i}@mail{i}.example"
        rows.append((i, " ".join(around)))
    got = {r["doc_id"]: r for r in private_data.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        at = text.find("Quuxworks")
        assert (got[i]["n_generalised"], got[i]["n_removed"]) == ((1, 0) if i < 6 else (0, 0))
        assert (f"generalised:{at}:{at + 9}" in got[i]["spans"].split(",")) == (i < 6)


def test_shares_of_information_against_plain_counts(spark):
    rng = random.Random(6)
    parts = [f"plain{i}" for i in range(20)] + ["q@r.example", "+1 (212) 555-0100", "+12125550100", "10.0.0.7", "x7", "Ünïcode"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words, support in ((5, 2), (2, 1)):
        got = {(r["entity"], r["term"]): r["share"] for r in private_data.evidence(docs, words, support)[2].collect()}
        want = brute_shares(rows, words, support)
        assert got.keys() == want.keys()
        assert len(got) > 20
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)
    assert private_data.term_counts(docs, docs.select(F.lit("plain3").alias("term")), 0).collect() == private_data.term_counts(docs, docs.select(F.lit("plain3").alias("term"))).collect()


def test_a_text_of_very_many_entities_takes_linear_time(spark):
    text = " ".join(f"10.{i % 200}.{i // 200 % 200}.7 word{i % 50}" for i in range(100_000)) + " 123, 45" * 100_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    assert docs.select(F.size(private_data.base_spans(F.col("text"))).alias("n")).first()["n"] == 100_000
    assert time.monotonic() - began < 30
    clean = private_data.sanitised(docs, generalise=9.0).first()["text"]
    assert clean.startswith("<IP> word0 <IP> word1 ")
    assert clean.count("<IP>") == 100_000
    assert clean.endswith(" 123, 45")


def test_sanitised_replaces_all_of_spans_that_overlap(spark):
    text = "call +1 (212) 555-0100.1.2.3 or 4111 1111 1111 1111.2.3.4 now " + "ü" * 2500 + " a@b.c end"
    got = private_data.sanitised(spark.createDataFrame([(1, text), (2, None), (None, "no one")], "doc_id long, text string")).collect()
    want, at = "", 0
    spans = sorted((int(a), private_data.KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in brute_private(text).split(",")))
    for a, k, b in spans:
        if a >= at:
            want += text[at:a] + f"<{private_data.KINDS[k].upper()}>"
        at = max(at, b)
    assert {r["doc_id"]: r["text"] for r in got} == {1: want + text[at:], 2: "", None: "no one"}


def test_private_awkward_rows(spark):
    got = private_data.digest(awkward(spark)).collect()
    assert len(got) == 11
    row = next(r for r in got if r["doc_id"] == 10)
    assert (row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1)
    assert next(r for r in got if r["doc_id"] is None)["n_email"] == 1
    assert next(r for r in got if r["doc_id"] == 3)["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert private_data.digest(empty(spark)).count() == 0
    assert private_data.sanitised(awkward(spark)).count() == 11


def brute_secrets(text):
    text, found = text or "", []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_base_spans_against_plain_patterns():
    alphabet = ["token", "Api_Key", "ſecret", "apikey", "secret", "=", ":", " ", "'", '"', "abc123", "AKIA", "Q7Z", "0123456789ab", "deadbeef", "\n", "é", "PASSWORD", "."]
    for text in invented(7, 4000, alphabet):
        assert secrets.base_spans(text) == brute_secrets(text), text


def test_secret_digest_on_documents_and_awkward_rows(spark):
    docs = documents(spark, 300)
    want = {r["doc_id"]: hashlib.sha256(secrets.listed(brute_secrets(r["text"])).encode()).hexdigest() for r in docs.collect()}
    assert {r["doc_id"]: r["base_sha256"] for r in secrets.scan(docs).collect()} == want
    got = secrets.scan(awkward(spark)).collect()
    assert len(got) == 11
    row = next(r for r in got if r["doc_id"] == 10)
    assert (row["n_assign"], row["n_access"]) == (1, 1)
    assert secrets.scan(empty(spark)).count() == 0


def test_models_of_made_samples_tell_random_strings_from_identifiers(spark):
    docs = documents(spark)
    judge = secrets.trained(secrets.made_samples(docs, 400))
    rng = random.Random(40)
    texts = [r["text"] for r in docs.collect()][:300]
    plain = [v for t in texts for v in secrets.identifiers(t, rng)]
    assert len(plain) > 1000
    assert sum(secrets.gain(v, judge.ratio) >= judge.least for v in plain) <= 0.004 * len(plain)
    for name, alphabet in secrets.ALPHABETS.items():
        noise = ["".join(rng.choices(alphabet, k=32)) for _ in range(200)]
        assert sum(secrets.gain(v, judge.ratio) >= judge.least for v in noise) >= (150 if name in ("HEX", "hex", "lower") else 185), name
    clean = [t for t in texts if not secrets.base_spans(t)]
    assert sum(bool(secrets.scored_spans(t, judge, [])) for t in clean) <= 0.01 * len(clean)


def test_gains_are_log_ratios_of_smoothed_counts(spark):
    rows = [("AbAbZ", True), ("ab_ab", False), ("ab", False), (None, True), ("x", None)]
    got = secrets.ratio_table(secrets.counted(spark.createDataFrame(rows, "value string, random boolean")))
    k, code = secrets.K, {chr(c): i for i, c in enumerate(secrets.ALPHABET, 1)} | {"\0": 0}

    def log_p(value, random):
        seen = Counter(p for v, r in rows if v is not None and r is random for p in zip("\0" + v, v + "\0", strict=True))
        after = Counter()
        for (a, _), n in seen.items():
            after[a] += n
        return sum(math.log((seen[a, b] + 1) / (after[a] + k)) for a, b in zip("\0" + value, value + "\0", strict=True))

    for value in ("AbAb", "ab_ab", "Zz9"):
        assert math.isclose(secrets.gain(value, got), log_p(value, True) - log_p(value, False))
    assert code["A"] == 1


def test_own_samples_set_the_threshold_and_rests_of_runs_are_scored(spark):
    rng = random.Random(4)
    letters = secrets.ALPHABETS["base62"]
    noise = lambda n=30: "".join(rng.choice(letters) for _ in range(n))
    parts = ["get", "value", "index", "table", "row", "count", "user", "name", "list", "parse", "buffer", "2", "v1"]
    plain = lambda: "_".join(rng.choice(parts) for _ in range(rng.randint(5, 8)))
    samples = spark.createDataFrame([(noise(), True) for _ in range(800)] + [(plain(), False) for _ in range(800)] + [(None, True)], "value string, random boolean")
    head, tail = noise(24) + "G", "G" + noise(24)
    rows = [(1, f"see {noise()} here"), (2, f"see {plain()}_v1 here"), (3, f"{head}{'0a' * 14}{tail}")]
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), samples).collect()}
    assert {i: r["n_markov"] for i, r in got.items()} == {1: 1, 2: 0, 3: 2}
    assert got[3]["n_hex"] == 1
    clean = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), samples, texts=True).collect()
    assert all(head not in r["text"] and tail not in r["text"] for r in clean)
    empty_judge = secrets.trained(samples.where("false"))
    assert empty_judge.least == 12.0


def test_redaction_joins_overlapping_spans():
    assert secrets.redact("ab token=abcdef cd", [(3, 0, 15), (9, 2, 15)]) == "ab <SECRET> cd"
    assert secrets.redact("plain", []) == "plain"
