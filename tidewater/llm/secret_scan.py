"""Secret scan with false-positive removal by a random forest, with DataFrame operations only.

Candidates in the words of a text: runs of at least 16 characters of keys and hashes with a digit, or an upper-case letter behind a
lower-case one; such runs with the beginning of a known kind of key, whatever follows; what is assigned to a word that names a secret, of six
characters or more, with any punctuation; passwords in URLs. Of candidates within each other the longest counts. A random forest looks at
each one's length, character transitions, dictionary coverage, the path it stands in and its neighbouring words, and is trained from
labelled findings. labelled_findings() makes a labelled set from patterns of public key formats and passwords, with look-alikes (commit ids,
checksums, UUIDs, card numbers, identifiers, paths, placeholders, settings); fit() takes any other with the same columns.

Defined results, a row for each secret: doc_id, word_pos (number of the word in the text, from 0), part (of several candidates in a word),
secret, score. Null or empty text holds none. Very long texts are scanned whole. A secret that occurs several times comes each time. Rows
that repeat a doc_id, or lack one, are scanned each on their own. An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import random
import re
import string

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import table

CANDIDATE = r"[A-Za-z0-9_+/\-]{16,}={0,2}"
#: What a candidate has besides: a digit, or an upper-case letter behind a lower-case one.
MIXED = r"[0-9]|[a-z][A-Z]"
#: How known kinds of keys begin; fixed values.
KEY_BEGINNINGS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_live_", "sk_test_", "pk_live_", "xoxb-", "xoxa-", "xoxp-", "AIza", "eyJ", "glpat-"]
#: Characters of a value that is assigned to the name of a secret, at least.
LEAST_ASSIGNED = 6
THRESHOLD = 0.5
#: Words on each side that count as neighbours.
NEIGHBOURS = 3
#: Labelled findings that are made, and the forest's size.
FINDINGS, TREES, DEPTH = 6000, 24, 9
REDACTED = "[SECRET]"

#: The commonest pairs of letters of European languages; fixed values.
LETTER_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
#: Words of file names, identifiers and placeholders; fixed values.
DICTIONARY = """about access account action active address admin album alpha android apache archive array article asset assets author backup banner base batch beta
binary block blog book boolean branch browser bucket buffer build bundle button cache calendar camera card cart case category change channel chapter chart check class
client cloud cluster code column command comment common company component config connection console contact content context control controller cookie copy core count
counter country create credit currency current custom customer data database date default delete demo design detail device dialog directory display docs document domain
download draft driver dummy edit editor element email empty enable engine english entity entry error event example export extension external factory failed false feature
feed field file filter final first folder font footer form format forum frame function gallery game gateway general global google graph group guide handler hash header
health height help helper here hidden history home host html icon image images import index info input insert install instance integer internal invalid invoice item java
javascript join json label language large last latest layer layout learn library license line link list loader local location login logo lower machine main manager manual
mapping master media member memory menu message method mobile model module month movie music name native network news node normal note number object offset online open
option order output package page panel parent parser part party password path payment photo picture placeholder plain player plugin point policy popup port post prefix
preview price print private process product production profile program project property provider public query queue random range reader record redirect reference
release remote render report request reset resource response result return review right role root route rule sample schema score screen script search second secret section
select sender server service session setting settings setup shared shop show simple single site size slide small social source space special spring stable staging standard
start state static status step storage store stream string student style submit summary super support switch system table target task team template term test text theme
thread thumb time title token tool total track training transfer tree true type unit update upload upper user utils valid value variable version video view virtual
visible volume warning week width window word work world wrapper write year your zone""".split()
#: Words that name a secret, and words that name something else of the same look; fixed values.
SECRET_WORDS = "token secret password passwd pwd apikey api_key api-key access_key auth bearer credential private key".split()
ASSIGNED_WORDS = "token secret password passwd passphrase pwd apikey api_key api-key access_key access-key secret_key credential credentials private_key".split()
PLACEHOLDERS = "changeme password required optional none null false true example your_password yourpassword xxxxxx ****** ...... <password> {password} ${PASSWORD} $PASSWORD os.environ getenv() hidden redacted unknown string default empty undefined invalid expired".split()
OTHER_WORDS = "commit checksum sha sha1 sha256 md5 hash uuid guid revision digest etag version build example sample dummy placeholder image page ref id order card phone call invoice".split()


def _any(words: list[str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


#: What names a secret, with the sign before its value; what may stand behind a value. Patterns take time in proportion to a word, however long.
_NAMED = r"(?i)(?:{})[\"']?\s*[:=]=?".format(_any(ASSIGNED_WORDS))
_VALUE = r"[\"']?([^\s\"']{%d,})" % LEAST_ASSIGNED
_BEHIND = ".,;:)]}>#&$%*"
_IN_URL = r"^[A-Za-z][A-Za-z0-9+.\-]{1,20}://[^\s:/@]+:([^\s/@]{3,})@"
_KNOWN, _HAS_KNOWN = f"^({'|'.join(KEY_BEGINNINGS)})", "|".join(KEY_BEGINNINGS)


def _in_word(w: Column, before: Column) -> Column:
    """The candidates in a word, the longest of each other's parts; before: the two words before it."""
    none = F.array().cast("array<string>")
    runs = F.filter(F.regexp_extract_all(w, F.lit(CANDIDATE), F.lit(0)), lambda c: c.rlike(MIXED) | c.rlike(_KNOWN))
    inside = F.when(w.contains("=") | w.contains(":"), F.regexp_extract(w, _NAMED + _VALUE, 1))
    behind = F.when(before.endswith("=") | before.endswith(":"), F.when(before.rlike(_NAMED + "$"), F.regexp_extract(w, "^" + _VALUE, 1)))
    url = F.when(w.contains("://"), F.regexp_extract(w, _IN_URL, 1))
    values = F.filter(F.transform(F.array(inside, behind), lambda v: F.rtrim(v, F.lit(_BEHIND))), lambda v: F.coalesce(F.length(v) >= LEAST_ASSIGNED, F.lit(False)))
    found = F.array_distinct(F.concat(F.when(F.length(w) >= 16, runs).otherwise(none), values, F.filter(F.array(url), lambda v: F.coalesce(v != "", F.lit(False)))))
    return F.filter(found, lambda c: ~F.exists(found, lambda d: (d != c) & d.contains(c)))


def _with_places(docs: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """kept, _words and _at: the numbers of the words that may hold candidates, which is quick to see: long mixed runs, and what is at or behind an assignment."""
    words = docs.select(*kept, F.split("text", r"[\x20\x09-\x0D]+").alias("_words"))
    signed = lambda w: w.contains("=") | w.contains(":")
    own = F.transform("_words", lambda w, i: F.when(signed(w) | ((F.length(w) >= 16) & w.rlike(CANDIDATE) & (w.rlike(MIXED) | w.rlike(_HAS_KNOWN))), i))
    behind = F.transform("_words", lambda w, i: F.when(w.endswith("=") | w.endswith(":"), i + 1))
    return words.select(*kept, "_words", F.array_distinct(F.array_compact(F.concat(own, behind))).alias("_at"))


def candidates(docs: DataFrame, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, word_pos, part, candidate, word, before, after (neighbouring words), a row a candidate."""
    at = _with_places(docs, kept)
    near = lambda i, a, b: F.array_join(F.slice("_words", F.greatest(i + 1 + a, F.lit(1)), F.greatest(F.least(i + b, F.size("_words")) - F.greatest(i + a, F.lit(0)), F.lit(0))), " ")
    found = F.transform("_at", lambda i: F.struct(i.alias("word_pos"), F.get("_words", i).alias("word"), near(i, -2, 0).alias("_two"), near(i, -NEIGHBOURS, 0).alias("before"), near(i, 1, 1 + NEIGHBOURS).alias("after")))
    rows = at.select(*kept, F.inline(found)).where("word is not null")
    parts = rows.select(*kept, "word_pos", "word", "before", "after", F.posexplode(_in_word(F.col("word"), F.col("_two"))).alias("part", "candidate"))
    return parts.select(*kept, "word_pos", "part", "candidate", "word", "before", "after")


def features() -> dict[str, Column]:
    """Of a row with candidate, word, before and after."""
    c, word, low = F.col("candidate"), F.col("word"), F.lower("candidate")
    n = F.length(c)
    share = lambda pattern, text=c: F.regexp_count(text, F.lit(pattern)) / n
    lead = F.expr("lower(substring_index(word, candidate, 1))")  # the word before the candidate begins
    around = F.concat_ws(" ", F.lower("before"), lead, F.lower("after"))
    named = F.concat_ws(" ", F.element_at(F.split(F.lower("before"), " "), -1), F.element_at(F.split(F.concat(F.lit("  "), F.lower("before")), " "), -2), lead)
    return {
        "length": n.cast("double"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "odd_symbols": share(r"[^A-Za-z0-9_+/=\-]"),
        "kinds": (c.rlike("[a-z]").cast("int") + c.rlike("[A-Z]").cast("int") + c.rlike("[0-9]").cast("int") + c.rlike("[^A-Za-z0-9]").cast("int")).cast("double"),
        "in_url": word.rlike(r"://[^\s:/@]+:[^\s/@]+@").cast("double"),
        "vowels": share("[aeiou]", low),
        "transitions": share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "letter_pairs": share(f"(?=({'|'.join(LETTER_PAIRS)}))", low),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "hexadecimal": c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "all_digits": c.rlike(r"^[0-9\-_/+]+$").cast("double"),
        "longest_letters": F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), F.length)) / n,
        "repeats": F.regexp_count(c, F.lit(r"(.)\1")) / n,
        "dictionary": 1 - F.length(F.regexp_replace(low, _any(DICTIONARY), "")) / n,
        "slashes": F.regexp_count(word, F.lit(r"[/\\]")).cast("double"),
        "dots": F.regexp_count(word, F.lit(r"\.[A-Za-z]")).cast("double"),
        "dashes": F.regexp_count(c, F.lit("-")).cast("double"),
        "uuid": c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$").cast("double"),
        "known_prefix": c.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_|^sk_|^pk_live|^xox[abp]-|^AIza|^eyJ|^glpat-").cast("double"),
        "secret_word": around.rlike(_any(SECRET_WORDS)).cast("double"),
        "named_secret": named.rlike(f"({_any(SECRET_WORDS)})[\"']?\\s*[:=]").cast("double"),
        "other_word": around.rlike(f"\\b({_any(OTHER_WORDS)})\\b").cast("double"),
        "assigned": F.concat_ws(" ", F.col("before"), lead).rlike("[:=][\\s\"']*$").cast("double"),
    }


def with_features(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"f_{k}": v for k, v in features().items()})


def labelled_findings(spark: SparkSession, n: int = FINDINGS, seed: int = 1) -> DataFrame:
    """candidate, word, before, after, label: n findings, of kinds of secrets and of look-alikes in turn."""
    rng = random.Random(seed)
    hexa = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    mixed = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    upper = lambda n: "".join(rng.choices(string.ascii_uppercase + "234567", k=n))
    pick = lambda *of: rng.choice(of)
    prose = "the of and reader was on, table are. une maison pour der weg und por la casa light to seven under. with".split()
    talk = lambda k=3: " ".join(rng.choices(prose, k=k))
    word = lambda: rng.choice(DICTIONARY)
    name = lambda: pick("token", "secret", "password", "api_key", "apikey", "auth_token", "access_token", "client_secret", "API_KEY", "SECRET_KEY", "pwd", "private_key")
    own = lambda: f"{talk(1)} {name()} {pick('=', ':')}"
    syllables = lambda: "".join(rng.choices("th er in ing ation ver lich keit ment ción tre and ou schaft bar und".split(), k=rng.randint(4, 8)))
    end = lambda: pick("", "", ".", ",", "###")
    setting = lambda: pick("password", "passwd", "pwd", "DB_PASSWORD", "secret", "client_secret", "db_pwd", "PASSWORD", "token")

    def password() -> str:
        """As people make them: letters with digits, and mostly punctuation, in no order."""
        stem = pick(mixed(rng.randint(4, 8)), word().title(), syllables()[:6].title(), word().replace("o", "0").replace("e", "3"))
        tail = digits(rng.randint(1, 4)) + pick("", "!", "#", "@", "$", "&", "!!", "?", "-", "_") + pick("", mixed(rng.randint(1, 5)))
        return pick(stem + tail, pick("!", "$", "&") + stem + tail, stem + pick("!", "&", "%", ".") + tail)


    def quoted(text: str) -> str:
        q = pick('"', "'", "")
        return q + text + q + end()

    # (word, words before, label), made anew each time
    kinds = [
        lambda: (quoted(hexa(40)), own(), 1),
        lambda: ("AKIA" + upper(16) + end(), talk(), 1),
        lambda: (f"{name()}{pick('=', ':')}{hexa(18)}{end()}", talk(), 1),
        lambda: (quoted(mixed(40)), own(), 1),
        lambda: (pick("", "", name() + "=") + pick("ghp_", "gho_", "sk_live_", "sk_test_", "xoxb-", "AIza", "eyJ", "glpat-") + mixed(36) + end(), talk(), 1),
        lambda: (f"{name()}{pick('=', ':')}{quoted(mixed(rng.randint(16, 50)))}", talk(), 1),
        lambda: (hexa(rng.randint(16, 64)) + end(), own(), 1),
        lambda: (mixed(rng.randint(20, 50)), f"{talk(1)} {pick('Authorization: Bearer', 'Bearer', 'credential:')}", 1),
        lambda: (f"{setting()}{pick('=', ':')}{quoted(password())}", talk(), 1),
        lambda: (quoted(password()), f"{talk(1)} {setting()} {pick('=', ':')}", 1),
        lambda: (f"{pick('postgres', 'mysql', 'https', 'redis', 'amqp')}://{word()}:{password()}@{pick('db', 'host', 'localhost', 'cache')}.{word()}.com/{word()}", talk(), 1),
        lambda: (pick("AKIA", "ASIA") + "".join(rng.choices(string.ascii_uppercase, k=16)) + end(), talk(), 1),
        lambda: (f"{setting()}{pick('=', ':')}{quoted(''.join(rng.choices(pick(string.ascii_lowercase, string.ascii_uppercase), k=rng.randint(16, 32))))}", talk(), 1),
        lambda: (f"{setting()}{pick('=', ':')}{quoted(rng.choice(PLACEHOLDERS))}", talk(), 0),
        lambda: (quoted(pick(rng.choice(PLACEHOLDERS), syllables(), word(), rng.choice(prose) + rng.choice(prose))), f"{talk(1)} {setting()} {pick('=', ':')}", 0),
        lambda: (f"{pick('https', 'http')}://www.{word()}.com:{digits(4)}/{word()}@{word()}", talk(), 0),
        lambda: (f"{setting()}:{pick(word(), syllables(), word() + '_' + word(), word() + '.' + word(), digits(6))}" + end(), talk(), 0),
        lambda: (hexa(40) + end(), f"{talk(2)} {pick('commit', 'revision', 'sha1', 'ref', 'etag:')}", 0),
        lambda: (pick("sha256:", "", "sha256-") + hexa(64), f"{talk(2)} {pick('checksum', 'digest', 'sha256', 'hash')}", 0),
        lambda: (digits(16) + end(), talk(), 0),
        lambda: ("-".join((hexa(8), hexa(4), hexa(4), hexa(4), hexa(12))), f"{talk(2)} {pick('id', 'uuid', 'the', 'order')}", 0),
        lambda: (pick("", "http://www.example.com/", "./") + f"{word()}/{word()}/{word()}{rng.randint(0, 99)}/{word()}" + pick(".png", ".java", "", ".html"), talk(), 0),
        lambda: (word() + word().title() + word().title() + word().title() + str(rng.randint(0, 99)) + pick("()", "", ";", ","), talk(), 0),
        lambda: (f"{word()}_{word()}_{word()}_{word()}_{rng.randint(0, 9)}", pick(own(), talk()), 0),
        lambda: (quoted(pick("your_api_key_here_", "xxxxxxxxxxxxxxxxxxxx", "EXAMPLE_KEY_EXAMPLE_", "insert-token-here-", "changeme_changeme_", "000000000000000000", "1234567890abcdef") + str(rng.randint(0, 9))), own(), 0),
        lambda: (f"20{digits(2)}-{digits(2)}-{word()}-{word()}-v{rng.randint(0, 9)}", talk(), 0),
        lambda: (syllables() + pick("", "A", "1") + syllables() + pick("", str(rng.randint(0, 9))) + end(), talk(), 0),
        lambda: (f"/{word()}/{hexa(2)}/{hexa(32)}" + pick(".png", ".jpg", ".js", ".css"), talk(), 0),
        lambda: (digits(10) + pick("-", "", "/") + digits(8), f"{talk(2)} {pick('phone', 'call', 'card', 'order', 'invoice')}", 0),
    ]
    rows = []
    for i in range(n):
        found, before, label = kinds[i % len(kinds)]()
        rows.append((i, f"{before} {found} {talk()}", len(before.split()), float(label)))
    # Candidates are cut from the words as the scan does it; what makes none is left out.
    made = spark.createDataFrame(rows, "doc_id int, text string, pos int, label double")
    return candidates(made, ("doc_id", "pos", "label")).where("word_pos = pos").select("candidate", "word", "before", "after", "label")


def fit(findings: DataFrame, seed: int = 11) -> RandomForestClassificationModel:
    """A forest from labelled findings (candidate, word, before, after, label)."""
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_predicted")
    return forest.fit(_assembled(findings.coalesce(1)).select("_features", "label"))  # one partition: the same trees each time


def _assembled(rows: DataFrame) -> DataFrame:
    assembler = VectorAssembler(inputCols=[f"f_{k}" for k in features()], outputCol="_features", handleInvalid="keep")
    return assembler.transform(with_features(rows).na.fill(0.0, [f"f_{k}" for k in features()]))


def scored(rows: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """rows with score, the forest's probability of a secret."""
    out = model.transform(_assembled(rows)).withColumn("score", F.get(vector_to_array("_probability"), F.lit(1)))
    return out.select(*rows.columns, "score")


def secrets(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, word_pos, part, secret, score of each candidate that the forest takes for a secret."""
    model = model or fit(labelled_findings(docs.sparkSession))
    found = scored(candidates(docs), model).where(F.col("score") >= threshold)
    return found.select("doc_id", "word_pos", "part", F.col("candidate").alias("secret"), "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by document and place, masked but for four characters."""
    found = secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word_pos", "part", F.concat(F.substring("secret", 1, 4), F.lit("...")).alias("masked"), F.length("secret").alias("length"), F.round("score", 6).alias("score"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with REDACTED in the place of each secret, and of other places in the document where the same string stands.

    Longer secrets are replaced before those within them. Rows without words that may hold any are passed on as they are; only the others are grouped and joined.
    Rows are told apart by doc_id (also null) and text, so that none gets another's secrets; equal rows get the same. Null and empty texts stay.
    An empty table gives no rows. All columns are returned as they came, whatever their names.
    """
    bare = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    marked = _with_places(bare, ("_row", "doc_id", "text")).withColumn("_suspect", F.coalesce(F.size("_at") > 0, F.lit(False))).drop("_words", "_at")
    some = marked.where("_suspect").select("_row", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    model = fit(labelled_findings(spark))
    found = scored(candidates(some, ("_id", "_hash")), model).where(F.col("score") >= THRESHOLD)
    longest = lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0)
    by_row = found.groupBy("_id", "_hash").agg(F.array_sort(F.collect_set("candidate"), longest).alias("_secrets"))
    by_row = by_row.select(F.col("_id").alias("_found_id"), F.col("_hash").alias("_found_hash"), "_secrets")
    some = some.join(by_row, some["_id"].eqNullSafe(by_row["_found_id"]) & (some["_hash"] == by_row["_found_hash"]), "left")
    clean = F.when(F.col("_secrets").isNull(), F.col("text")).otherwise(F.aggregate("_secrets", F.col("text"), lambda text, secret: F.replace(text, secret, F.lit(REDACTED))))
    out = some.select("_row", clean.alias("_text")).union(marked.where("not _suspect").select("_row", F.col("text").alias("_text")))
    return out.select(*(F.col("_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))
