"""Patterns on long lines: linear time, no deep recursion, and the hits of the plain patterns."""

import random
import time

import pytest
from pyspark.sql import functions as F

from codestrata import fixed_values as fv
from codestrata.functions.linear import FUNCTION_FORMS, LINEAR
from codestrata.functions.regex import to_java
from codestrata.functions.text import sql_string
from codestrata.operators import complexity
from codestrata.operators.security import rule_hit

LONG = 512 * 1024
PIECES = {
    "rules": ["format ", '"', "'", "+", "a", "fmt.Sprintf(", 'f"', "SELECT ", "WHERE ", "OR ", "open(", "os.Open(", ")", "(", "user=", "username:x",
              "pass=p", "password:", "print(", "log.Print (", "token", "key", "Blowfish", "New", " ", "cors", "*", "allowOrigin", "exec.Command(",
              "os.system(", "%", "%s", "subprocess.run(", "shell = True", "execSync(", "eval (", "${", "innerHTML", "=", "document.write(", "`",
              ".html(", "fetch(", "net.Dial(", "json.Unmarshal(", ",", "any", "interface{}", "iv=", "salt:", "[]byte{", "bytes(", 'b"', "}",
              "rsa.GenerateKey(", "1024", "512", "#", "//", "TODO", "auth", ".env", ".key", "load", ".raw(", "{", "mysql://", "@", "eyJ",
              "abcdefghijk", ".", "sendFile(", "eyJabcdefghijk.abcdefghijk.abcdefghijk", "'+a+'"],
    "functions": ["public", "private", "static", "protected", " ", "  ", "\t", "int", "foo", "(", ")", "function", "x1", "publicstatic", "function("],
}


def lines(kind, n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES[kind]) for _ in range(r.randint(1, 14))).strip() for _ in range(n)]


def test_linear_forms_hit_what_the_patterns_hit(spark):
    r = random.Random(1)
    texts = lines("rules", 30_000, 2)
    for pattern in LINEAR:  # lines rich in one pattern's own words
        own = [p for p in PIECES["rules"] if p.strip() and p.strip("( ").lower() in pattern.lower().replace("\\", "")] + [" ", "x", '"', ")", ",", "+"]
        texts += ["".join(r.choice(own) for _ in range(r.randint(1, 9))) for _ in range(400)]
    table = spark.createDataFrame([(t,) for t in texts], "line string")
    wrong = table.select(*(
        F.sum((F.expr(f"line RLIKE {sql_string(to_java(p))}") != F.expr(f"line RLIKE {sql_string(to_java(q))}")).cast("int")).alias(f"w{i}")
        for i, (p, q) in enumerate(LINEAR.items())), *(
        F.sum(F.expr(f"line RLIKE {sql_string(to_java(p))}").cast("int")).alias(f"h{i}") for i, p in enumerate(LINEAR))).first()
    assert [k for k in range(len(LINEAR)) if wrong[f"w{k}"]] == []
    assert [list(LINEAR)[k] for k in range(len(LINEAR)) if not wrong[f"h{k}"]] == []


@pytest.mark.parametrize("language", ("Java", "PHP"))
def test_function_forms_give_the_same_name(spark, language):
    pattern, groups = fv.FUNCTION_PATTERNS[language]
    table = spark.createDataFrame([(t, language) for t in lines("functions", 40_000, 3)], "trimmed string, language string")
    plain = F.coalesce(*(F.expr(f"nullif(regexp_extract(trimmed, {sql_string(to_java(pattern))}, {g}), '')") for g in groups))
    both = table.select("trimmed", plain.alias("plain"), complexity.function_name().alias("form"))
    assert both.filter(~F.col("plain").eqNullSafe(F.col("form"))).limit(5).collect() == []
    assert both.filter("plain IS NOT NULL").count() > 50 and pattern in FUNCTION_FORMS


HEADS = ["format ", "'+a+'", "open(", "user=a ", "print(", "blowfish ", "exec.Command(", "os.system(", "subprocess.run(", "execSync(", "eval(",
         "innerHTML=", ".html(", "fetch(", "net.Dial(", "json.Unmarshal(", "iv=bytes(", "rsa.GenerateKey(", "#todo ", "cors ", ".env ", ".raw('",
         "mysql://", "eyJ", "sendFile(", "query('", "password='", "-----BEGIN ", " ", "(", "'", "\"", "a", "/", "https://hooks.slack.com/services/T"]


@pytest.mark.parametrize("head", HEADS)
def test_rules_on_a_long_line(spark, head):
    table = spark.createDataFrame([(head * (LONG // len(head)),)], "line string").withColumn("low", F.lower("line")).cache()
    table.count()
    hits = [F.expr(rule_hit(r)).alias(f"r{n}") for n, r in enumerate(fv.SECURITY_RULES)]
    start = time.perf_counter()
    table.select(*hits).collect()
    assert time.perf_counter() - start < 2 + 4  # all 62 rules together, and compiling them
    table.unpersist()


@pytest.mark.parametrize("line", ("public" + " " * LONG + "x(", "public " * (LONG // 7) + "(", "static" * (LONG // 6) + " (", "func (" + ") " * (LONG // 2),
                                  "function " * (LONG // 9), "local " * (LONG // 6) + "function", "const a = " * (LONG // 10), "def " + " " * LONG))
def test_function_patterns_on_a_long_line(spark, line):
    table = spark.createDataFrame([(line, n) for n in fv.FUNCTION_PATTERNS], "trimmed string, language string").cache()
    table.count()
    start = time.perf_counter()
    table.select(complexity.function_name()).collect()
    assert time.perf_counter() - start < 6
    table.unpersist()
