"""One line that each rule must find and one near miss that it must not."""

import random

import pytest
from pyspark.sql import functions as F

from codestrata import fixed_values as fv
from codestrata.operators import security
from codestrata.plans.analysis import Analysis

RANDOM = "q7Rw2Zx9Lk4Mv8Np3Tb6Yc1Hd5Jf0GsW"  # 32 characters, all different
HEX = "0f1e2d3c4b5a69788796a5b4c3d2e1f0"
UPPER = "ABCDEFGHIJKLMNOP"

#: rule number -> (line with a hit, line without)
CASES = {
    1: (f"k = 'AKIA{UPPER}'", f"k = 'AKIA{UPPER[:-1]}'"),
    2: (f"aws_secret = '{RANDOM}aB3/+=xY'", f"aws_secret = '{RANDOM}'"),
    3: (f"k = 'AIza{RANDOM}abc'", f"k = 'AIza{RANDOM}ab'"),
    4: (f"azure-key: '{RANDOM}'", "azure-key: 'aaaaaaaaaaaa'"),
    5: (f'api_key = "{RANDOM}"', 'api_key = "short"'),
    6: (f"password = '{RANDOM}'", "password = 'changeme'"),
    7: (f"Bearer {RANDOM}", "Bearer abc"),
    8: (f"basic {RANDOM}", "basic abc"),
    9: ("k = -----BEGIN EC " + "PRIVATE KEY-----", "-----BEGIN EC " + "PRIVATE KEY-----"),
    10: ("k = -----BEGIN PGP " + "PRIVATE KEY BLOCK-----", "k = -----BEGIN PGP PUBLIC KEY BLOCK-----"),
    11: ("x = redis://u:p@host", "x = redis://host"),
    12: ("user=me pass=secret1Xy9Qw7Zk", "username=me password=" + RANDOM),
    13: (f"eyJ{RANDOM}.{RANDOM}.{RANDOM}", f"eyJ{RANDOM}.{RANDOM}"),
    14: (f"signing_key: '{RANDOM}'", "signing_key: 'aaaabbbb'"),
    15: ("https://hooks.slack.com/services/T1/B2/x", "https://hooks.slack.com/services/t1/B2/x"),
    16: (f"xoxb-1234567890-1234567890-{RANDOM}", f"xoxb-123-1234567890-{RANDOM}"),
    17: (f"ghp_{RANDOM}abcd", f"ghp_{RANDOM}"),
    18: (f"glpat-{RANDOM}", "glpat-abc"),
    19: (f"sk_live_{RANDOM}", f"sk_prod_{RANDOM}"),
    20: (f"pk_test_{RANDOM}", "pk_test_abc"),
    21: (f"SG.{RANDOM}.{RANDOM}", f"SG.{RANDOM}"),
    22: (f"SK{HEX}", f"SK{HEX.upper()}"),
    23: ('q := fmt.Sprintf("select x", y)', 'q := fmt.Sprintf("chose x", y)'),
    24: ("x = 'a' + v + ' where b", "x = 'a' + v + ' whereb"),
    25: ('db.Query("x" + y)', 'db.Query("x", y)'),
    26: ("m.raw(f'x {y}')", "m.raw('x')"),
    27: ('exec.Command("a" + b)', 'exec.Command("a", b)'),
    28: ('os.system("a" + b)', 'os.system("a")'),
    29: ("subprocess.run(a, shell=True)", "subprocess.run(a, shell=False)"),
    30: ("execSync(a + b)", "execSync(a)"),
    31: ("eval (a + b)", "retrieval(a + b)"),
    32: ("Runtime.getRuntime().exec(a + b)", "Runtime.getRuntime().exec(a)"),
    33: ("e.innerHTML = a + b", "e.innerHTML = ab"),
    34: ("$(e).html(a + b)", "$(e).html(a)"),
    35: ("<p dangerouslySetInnerHTML={x}>", "<p setInnerHTML={x}>"),
    36: ("template.HTML(x)", "template.HTMLx"),
    37: ("open(a + b)", "open(a)"),
    38: ("p = '../x'", "p = '..x'"),
    39: ("res.sendFile(a + b)", "res.sendFile(a)"),
    40: ("fetch(a + b)", "fetch(a)"),
    41: ("net.Dial(t, a + b)", "net.Dial(t, a)"),
    42: ("yaml.load(x)", "yaml.safe_load(x)"),
    43: ("json.Unmarshal(b, interface{}(x))", "json.Unmarshal(b, &x)"),
    44: ("md5.New()", "xmd5.New()"),
    45: ("sha1.Sum(x)", "sha1.Sums(x)"),
    46: ('"crypto/md5"', '"crypto/sha256"'),
    47: ("hashlib.md5(x)", "hashlib.sha256(x)"),
    48: ("des.NewCipher(k)", "aes.NewCipher(k)"),
    49: ("c = RC4", "c = RC45"),
    50: ("Blowfish.New(k)", "Blowfish(k)"),
    51: ("AES.MODE_ECB", "AES.MODE_CBC"),
    52: ("nonce = []byte{1, 2}", "nonce = rand(2)"),
    53: ('"math/rand"', '"crypto/rand"'),
    54: ("random.choice(x)", "random.choices(x)"),
    55: ("rsa.GenerateKey(r, 1024)", "rsa.GenerateKey(r, 2048)"),
    56: ("isAdmin = true", "isAdmin = f()"),
    57: ("x() // TODO fix login", "x() // TODO fix colour"),
    58: ("cors(x, '*')", "cors(x)"),
    59: ("print(token)", "print(x)"),
    60: ("debug: true", "debug: false"),
    61: ("printStackTrace()", "printStackTraces()"),
    62: ("load('.env')  # open", "load('.environment')"),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = []
    for rule, (hit, miss) in CASES.items():
        rows += [(rule * 2, f"h{rule}.go", hit), (rule * 2 + 1, f"m{rule}.go", miss)]
    files = spark.createDataFrame(rows, "file_id long, path string, content string")
    issues = Analysis(files).security_issues.select("file_id", "rule_no").collect()
    return {(r.file_id, r.rule_no) for r in issues}


def test_every_rule_has_a_case():
    assert sorted(CASES) == list(range(1, len(fv.SECURITY_RULES) + 1))
    assert len(fv.SECURITY_RULES) == 62


@pytest.mark.parametrize("rule", CASES)
def test_rule(found, rule):
    assert (rule * 2, rule) in found
    assert (rule * 2 + 1, rule) not in found


def test_gates_lose_nothing(spark):
    lines = [line for case in CASES.values() for line in case]
    rows = [(n, f"f{n}.py", x) for n, x in enumerate(lines + [x.upper() for x in lines] + [strange_case(x) for x in lines]
                                                       + [x.replace("s", "\u017f") for x in lines] + [x.replace("k", "\u212a") for x in lines])]
    a = Analysis(spark.createDataFrame(rows, "file_id long, path string, content string"))
    columns = ("file_id", "line_no", "rule_no")
    gated = security.scan(a.lines).select(*columns).collect()
    plain = security.scan(a.lines, gated=False).select(*columns).collect()
    assert sorted(gated) == sorted(plain) and len(gated) > 62


def strange_case(line):
    """Signs that fold to s and k, and those that look as if they folded to i."""
    return line.translate(str.maketrans("sSkKiI", "\u017f\u017f\u212a\u212a\u0131\u0130"))


def test_case_folds_as_in_re2(spark):
    import duckdb

    from codestrata.functions.linear import LINEAR
    from codestrata.functions.regex import to_java
    from codestrata.functions.text import sql_string

    r = random.Random(5)
    golden = [line for case in CASES.values() for line in case] + ["TODO: x", "hack: fix", "skip hints", "message", "Usage", "bug x"]
    texts = [strange_case(line) for line in golden]
    for line in golden * 12:
        texts.append("".join(strange_case(c) if r.random() < 0.3 else c for c in line))
    patterns = [x.pattern for x in fv.SECURITY_RULES] + [fv.DEFINITION_LINE_PATTERN, fv.TODO_PATTERN]
    table = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, line string")
    got = table.select("n", *(
        F.expr(f"line RLIKE {sql_string(to_java(LINEAR.get(p, p)))}").alias(f"p{i}") for i, p in enumerate(patterns))).orderBy("n").collect()
    wanted = [duckdb.execute("SELECT regexp_matches(unnest($1), $2)", [texts, p]).fetchall() for p in patterns]
    wrong = [(p, texts[n], row[f"p{i}"]) for i, p in enumerate(patterns) for n, row in enumerate(got)
             if row[f"p{i}"] != wanted[i][n][0]]
    assert wrong == []


def test_skipped_lines(files):
    secret = f"password = '{RANDOM}'"
    content = "\n".join(
        [secret, "// " + secret, "  # " + secret, "* " + secret, "; " + secret, "usage: " + secret,
         "\u00a0", "msg " + secret, "  " + secret + "\r"])
    issues = Analysis(files([("a.py", content)])).security_issues.collect()
    assert [(i.line_no, i.rule_no) for i in issues] == [(1, 6), (9, 6)]


def test_secrets_of_tests_count_less_when_paths_matter(files):
    corpus = files([("tests/a.py", f"token = '{RANDOM}'\nh = md5.New()"), ("src/a.py", f"token = '{RANDOM}'")])
    for aware, severities in ((False, {(0, 6): 3, (0, 44): 2, (1, 6): 3}),
                              (True, {(0, 6): 0, (0, 44): 2, (1, 6): 3})):
        rows = Analysis(corpus, path_aware=aware).security_issues.collect()
        assert {(r.file_id, r.rule_no): r.severity for r in rows} == severities


def test_entropy_counts_characters_over_bytes(spark):
    df = spark.createDataFrame([("abcdefgh",), ("aaaa",), ("\u00e9\u00e9",), ("abcdefghABCDEFGH",)], "v string")
    from codestrata.functions.text import entropy_sql
    got = [r[0] for r in df.select(F.expr(entropy_sql("v"))).collect()]
    assert got == [3.0, 0.0, 0.5, 4.0]
