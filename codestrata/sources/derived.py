"""Corpora and change logs derived from the driver's tables.

The tables hold prose and trade data, no source code.  ``code_files`` turns every
document into one source file, word by word: each run of six words picks a line (or
block) template by its hash and is set into it.  It is a narrow transformation, so
the corpus grows with ``documents`` and no file depends on another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.text import bound
from codestrata.sources.corpus import co_locate

WORDS_PER_CHUNK = 6

#: 43 extensions against 13 directories: every pair occurs.
EXTENSIONS = (
    ".go", ".go", ".go", ".go", ".go", ".py", ".py", ".py", ".py", ".js", ".js", ".js",
    ".ts", ".ts", ".java", ".java", ".java", ".rs", ".rs", ".rb", ".rb", ".lua", ".lua",
    ".php", ".php", ".jsx", ".tsx", ".c", ".h", ".cpp", ".hpp", ".cs", ".sh", ".dart",
    ".kt", ".swift", ".scala", ".yaml", ".json", ".md", ".sql", ".txt", "",
)
DIRECTORIES = (
    "src/", "src/core/", "lib/util/", "tests/", "src/core/io/", "app/", "", "cmd/API/",
    "vendor/pkg/", "src/.hidden/", "src/build/gen/", "app/Views/", "lib/",
)

#: @T@ text, @H@ 32 hex digits, @U@ 16 upper-case hex digits, @N@ number, @W@ identifier.
TEMPLATES = (
    # prose, comments, blank lines
    "@T@",
    "// @T@",
    "# @T@",
    "-- @T@",
    "/* @T@ */",
    " * @T@",
    "'''@T@'''",
    '"""@T@"""',
    "",
    "   \t",
    "\u00a0@W@ = compute(@N@)\u00a0",
    "let caf\u00e9_@W@ = \"@T@\"\r",
    "; @T@",
    # cloud keys and tokens
    'id = "AKIA@U@"',
    'id = "AKIA-@U@"',
    'aws_secret = "@H@01234567"',
    'aws_secret = "@H@"',
    'g = "AIza@H@abc"',
    "azure_key: '@H@'",
    "subscription-id = 'aaaaaaaaaa'",
    'apikey = "@H@"',
    'api_key = "changeme"',
    'password = "@H@"',
    'token: "@U@"',
    "pwd = 'xxxxxxxxxxxx'",
    'Authorization: Bearer @H@',
    'Authorization: Basic @H@',
    'pem = "-----BEGIN RSA ' 'PRIVATE KEY-----"',
    'pgp = "-----BEGIN PGP ' 'PRIVATE KEY BLOCK-----"',
    "-----BEGIN EC " "PRIVATE KEY-----",
    'conn = "postgres://u@N@:@W@@db.internal/x"',
    'conn = "postgres://db.internal/x"',
    "dsn user=@W@ host=x pass=@H@",
    "dsn username=@W@ password=@W@",
    "j = eyJ@H@.eyJ@H@.@H@",
    'signing_key = "@H@"',
    'jwt-secret = "aaaaaaaabbbb"',
    "https://hooks.slack.com/services/T@U@/B@U@/@H@",
    'x = "xoxb-12345678901-12345678901-@H@"',
    'x = "ghp_@H@abcd"',
    'x = "glpat-@H@"',
    'x = "sk_live_@H@"',
    'x = "pk_test_@H@"',
    'x = "SG.@H@.@H@"',
    'x = "SK@H@"',
    'x = "SK@U@"',
    # injection
    'q := fmt.Sprintf("SELECT * FROM t WHERE id=%s", @W@)',
    "sql = \"SELECT * FROM t\" + '\" + @W@ + \"' + \" AND x = 1\"",
    'db.Query("SELECT a FROM " + @W@)',
    'db.Query("SELECT a FROM t", @W@)',
    'Model.raw(f"delete {@W@}")',
    'exec.Command("sh " + @W@)',
    'os.system("ls %s" % @W@)',
    "subprocess.run(@W@, shell=True)",
    'child_process.exec("ls " + @W@)',
    'eval("x" + @W@)',
    'retrieval("x" + @W@)',
    'Runtime.getRuntime().exec("ls " + @W@);',
    "el.innerHTML = @W@ + tail",
    "$(el).html(@W@ + tail)",
    "<div dangerouslySetInnerHTML={x} />",
    "return template.HTML(@W@)",
    "f = open(base + @W@)",
    'p = "../@W@"',
    "res.sendFile(base + @W@)",
    "r = requests.get(base + @W@)",
    "c, err := net.Dial(\"tcp\", host + @W@)",
    "o = pickle.loads(@W@)",
    "o = yaml.safe_load(@W@)",
    "json.Unmarshal(buf, any)",
    # crypto
    "h := md5.New()",
    "h := sha1.Sum(@W@)",
    'import "crypto/md5"',
    "h = hashlib.md5(@W@)",
    "b, _ := des.NewCipher(@W@)",
    "c = ARC4(@W@)",
    "c = Blowfish(@W@).Encrypt()",
    "mode=ECB",
    "iv = bytes(@W@)}",
    "nonce = b'0000')",
    'import "math/rand"',
    "x = random.choice(@W@)",
    "k = rsa.GenerateKey(r, 1024)",
    "k = rsa.GenerateKey(r, 4096)",
    # authentication and disclosure
    "isAdmin = true",
    "x = 1 // TODO: fix auth for @W@",
    "cors(origin, '*')",
    "print(user.password)",
    "DEBUG = True",
    "e.printStackTrace()",
    "cfg = load('.env')",
    "usage: password = \"@H@\"",
    # functions of every language
    "func @W@(a int, b int) error {",
    "func (s *S) do@W@(ctx C, a, b, c, d, e int) {",
    "def get_@W@(self, a, b, c, d, e):",
    "    def inner_@W@(self):",
    "pub fn @W@<T>(a: T) {",
    "function @W@(a, b, c, d, e, f) {",
    "const @W@ = async (a) => {",
    "public static void @W@(int a, int b, int c, int d, int e, int f) {",
    "def @W@",
    "private function @W@($a) {",
    "local function @W@(a)",
    "fun @W@(a: Int) {",
    "static func @W@(a: Int) {",
    "int @W@ (int a) {",
    "end",
    "}",
    "    }",
    "{",
    "});",
    # branches
    "    if (a && b || c) {",
    "    else if (x) {",
    "    elif x and y:",
    "    elseif x then",
    "    elsif x",
    "    for i in range(@N@):",
    "        while True:",
    "    switch (x) {",
    "    case @N@:",
    "    match x {",
    "    loop {",
    "    repeat x",
    "    when (x) {",
    "    foreach ($a as $b) {",
    "    unless x",
    "    until x && y",
    "    rescue => e",
    "    with open(x) as f:",
    "    select {",
    "    go run()",
    "    defer close()",
    # indents
    "\t\t\t\t\tdeepTab(@N@)",
    "                        deep(@W@)",
    "                            deeper()",
    "  \t  x",
    "   odd()",
    # jumps
    "    return @W@\n}",
    "    return x\n    unreachable(@W@)",
    "    break\n\n    case 2:",
    "    throw e\n    next()",
    "    cb := func(x int) {\n        return x\n        more()\n    }",
    "    panic(\"@W@\")\n    // after",
    # error handlers
    "    if err != nil {\n        return err\n    }",
    "    if err != nil {\n    }",
    "} catch (Exception e) {\n\n}",
    "} catch (IOException e) {\n    log(e);\n}",
    "except ValueError as e:\n    pass",
    "except Exception as e:\n    raise",
    "p.catch(err => log(err))",
    "_ = doThing(@W@)",
    "_, _ = doThing(@W@)",
    "_ = fmt.Fprintf(w, x)",
    # numbers
    "x = call(@N@, 1024, 777)",
    "const limit = @N@",
    "color: #ff00aa @N@",
    "re = `[0-9]{@N@}` + 555",
    # names
    "userName = firstName + lastName",
    "user_name = first_name + last_name",
    "Result = handler(Data, tmp, ERR)",
    "self.@W@ = @W@",
    "vim.keymap.set('n', '@W@')",
    "document.querySelector('@W@')",
    "register(\"@W@\", '@W@')",
    # imports
    'import (\n\t"fmt"\n\t"net/@W@"\n\talias "a/b"\n\t_ "side/effect"\n)',
    "fmt.Println(x)",
    "alias.Do()",
    # markers
    "x() // FIXME @T@",
    "# HACK: @T@",
    "// This function handles the @W@",
    "# Note that @T@",
    "-- We need to use @W@",
    "// For simplicity, @T@",
    "# First, we load @W@",
    "// Loop through all @W@",
    "# Check if the input is @W@",
    "// 1. Setup the @W@",
    "# 2. Load the file",
    "-- 3. Return the result",
    # a block that repeats as it is
    "begin_block()\nstep_one(a)\nstep_two(b)\n\nstep_three(c)\nstep_four(d)\nend_block()",
)


def code_path(key: Column) -> Column:
    """The path of file number ``key``."""

    def pick(values: tuple[str, ...]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))

    hidden = F.when(key % 29 == 0, F.lit(".f")).otherwise(F.lit("f"))
    return F.concat(pick(DIRECTORIES), hidden, key.cast("string"), pick(EXTENSIONS))


def code_content(text: Column) -> Column:
    """Source text made of the words (most templates keep them only as hashes; the plain texts are registered as
    ``documents_*`` and ``pages_*``) of ``text``."""
    run = rf"((?:[^ ]* ){{{WORDS_PER_CHUNK - 1}}}[^ ]*) "
    chunks = F.split(F.regexp_replace(text, run, "$1\u0001"), "\u0001", -1)
    keyed = F.transform(chunks, lambda c: F.struct(c.alias("t"), F.md5(c).alias("h")))
    templates = F.array(*[F.lit(t) for t in TEMPLATES])

    def number(h: Column, first: int, digits: int) -> Column:
        return F.conv(F.substring(h, first, digits), 16, 10).cast("int")

    def line(x: Column) -> Column:
        h = x["h"]
        out = F.get(templates, number(h, 1, 6) % len(TEMPLATES))
        for mark, value in (
            ("@H@", h),
            ("@U@", F.upper(F.substring(h, 1, 16))),
            ("@N@", number(h, 7, 3).cast("string")),
            ("@W@", F.concat(F.lit("v"), F.substring(h, 11, 5))),
            ("@T@", x["t"]),
        ):
            out = F.replace(out, F.lit(mark), value)
        return out

    return F.array_join(F.transform(keyed, line), "\n")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus, already at the partition of its ``file_id`` (see ``corpus.co_locate``).

    The content is bound, so that a filter on it does not derive it a second time.
    """
    return _located_texts(spark, sf_dir).select(
        "file_id",
        code_path(F.col("file_id")).alias("path"),
        bound(code_content(F.col("text"))).alias("content"),
    )


def _located_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("file_id"), "text"
    )
    return co_locate(docs)


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a commit, its line items touch files."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("commit_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("author"),
        F.col("o_orderdate").alias("authored_at"),
    )
    touched = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .select(
            F.col("l_orderkey").alias("commit_id"),
            code_path(F.col("l_partkey")).alias("path"),
        )
        .distinct()
    )
    return touched.join(orders, "commit_id")


#: Repositories of ``ordered_change_log``.
ROOTS = 7


def ordered_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of several repositories, with ``root`` and ``seq``, whose times lie out of the log's order.

    A commit's place is a mixed number of its own, so neighbours of the log are days apart either way."""
    log = change_log(spark, sf_dir)
    return log.withColumns({
        "root": F.concat(F.lit("r"), (F.col("commit_id") % ROOTS).cast("string")),
        "seq": F.expr("(commit_id * 7919) % 1000003 * 1000000 + commit_id"),
    })


#: Lines that stood on top of a file before it was edited.
FIRST_DRAFT = 'password = "Tr0ub4dor-and-3"\nh := md5.New()\n// TODO: later\n'


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(arrival, file_id, version, path, content, deleted)``: the history of all files of the corpus.

    First come all files. Then a tenth is deleted, a tenth moved and three tenths edited into what
    the corpus holds. Last come late versions from between, of the deleted and of the edited."""
    files = _located_texts(spark, sf_dir).withColumn("kind", F.expr(
        "CASE file_id % 10 WHEN 0 THEN 'deleted' WHEN 1 THEN 'moved' WHEN 2 THEN 'edited' WHEN 3 THEN 'edited' WHEN 4 THEN 'edited' ELSE 'kept' END"))
    path = code_path(F.col("file_id"))
    moved = F.when(F.col("kind") == "moved", F.concat(F.lit("moved/"), path)).otherwise(path)
    first_lines = F.when(F.col("kind") == "edited", F.lit(FIRST_DRAFT)).otherwise(F.lit(""))

    def arrivals(number: int, version: int, kinds: tuple[str, ...] | None = None) -> DataFrame:
        some = files if kinds is None else files.filter(F.col("kind").isin(*kinds))  # before contents are derived
        last = version == 3
        content = code_content(F.col("text"))
        # the contents come last, so that what is known of a version can keep them from being derived
        return some.select(
            "file_id", F.lit(version).cast("long").alias("version"), (moved if last else path).alias("path"),
            (F.lit(last) & (F.col("kind") == "deleted")).alias("deleted"),
            (F.lit("") if last else first_lines).alias("first_lines"), "text",
        ).select(
            F.lit(number).alias("arrival"), "file_id", "version", "path",
            bound(F.concat("first_lines", content)).alias("content"), "deleted")

    return (
        arrivals(0, 1)
        .unionAll(arrivals(1, 3, ("deleted", "moved", "edited")))
        .unionAll(arrivals(2, 2, ("deleted", "edited"))))


#: Extensions given to the rows of a table of plain texts in turn; all of supported languages.
TEXT_EXTENSIONS = {"documents": (".md", ".sql", ".py", ".yaml", ".go"), "pages": (".js", ".php", ".rb")}


def text_files(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """``files`` of a table of plain texts: every row is a file with its whole text."""
    key, text = {"documents": ("doc_id", "text"), "pages": ("page_id", "html")}[table]
    extensions = TEXT_EXTENSIONS[table]
    extension = F.element_at(
        F.array(*map(F.lit, extensions)), (F.col(key) % len(extensions) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(
        F.col(key).alias("file_id"),
        F.concat(F.lit(f"{table}/"), F.col(key).cast("string"), extension).alias("path"),
        F.col(text).alias("content"))
