"""Rule tables and the expressions that apply them: participant categories, tags, error codes. Rules are parameters."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Category of a participant by its id.
CATEGORY_BY_ID = {
    "B01955": "retail", "B01668": "retail", "B02159": "retail", "B01590": "retail", "B02195": "retail",
    "C00019": "bank", "C00033": "bank", "C00039": "bank", "C00042": "bank",
    "C00010": "intl_broker",
}

# Category by the first of these that the upper-case name contains, in this order.
CATEGORY_BY_KEYWORD = [
    ("retail", ["FUTU", "TIGER BROKERS", "BRIGHT SMART", "INTERACTIVE BROKERS", "PHILLIP SECURITIES", "USMART", "LONG BRIDGE", "WEBULL", "MOOMOO", "UP SECURITIES", "MONMONKEY"]),
    ("bank", ["HONGKONG AND SHANGHAI BANKING", "HSBC", "BANK OF CHINA (HONG KONG)", "STANDARD CHARTERED BANK", "HANG SENG BANK", "CMB WING LUNG BANK", "ICBC (ASIA)", "CHINA CONSTRUCTION BANK", "INDUSTRIAL AND COMMERCIAL BANK", "DBS BANK", "CHONG HING BANK"]),
    ("boutique", ["KINGSTON SECURITIES", "GRANSING SECURITIES", "GET NICE", "KINGSWAY", "VAST HARBOUR", "CHINA EVERBRIGHT"]),
    ("intl_broker", ["MERRILL LYNCH", "MORGAN STANLEY", "GOLDMAN SACHS", "UBS SECURITIES", "UBS AG", "CITIGROUP", "CITIBANK", "J.P. MORGAN", "JPMORGAN", "CREDIT SUISSE", "DEUTSCHE", "BNP PARIBAS", "ABN AMRO", "MACQUARIE", "NOMURA", "BARCLAYS", "MERRILL"]),
]

# Tag of a share-capital change if its reason contains one of these.
REASON_TAGS = [
    ("placement", ["配售新股", "配售股份"]),
    ("option_exercise", ["行使购股权", "行使股份期权", "行使認股權", "行使认股权"]),
    ("buyback_cancellation", ["注销回购", "註銷回購"]),
    ("ipo", ["首发上市", "首發上市"]),
    ("consideration_issue", ["发行代价股份", "發行代價股份"]),
    ("rights_issue", ["供股"]),
    ("open_offer", ["公开发售", "公開發售"]),
    ("bonus_issue", ["红股", "紅股", "送股"]),
    ("consolidation", ["合股", "并股", "合併股份", "股份合并"]),
    ("subdivision", ["拆细", "拆細", "股份拆分"]),
    ("capital_reduction", ["削减股本", "削減股本", "股本削减"]),
]

# Tag of an announcement if lower(category and title) matches; "go" needs a word end before it here.
EVENT_TAGS = [
    ("share_consolidation", r"合股|股份合併|share consolidation|consolidation of shares|consolidat(?:e|ion)"),
    ("share_subdivision", r"拆股|subdivision|share split|split of shares"),
    ("rights_issue", r"供股|rights issue"),
    ("open_offer", r"公開發售|open offer"),
    ("placing", r"配售|placing|subscription"),
    ("general_offer", r"全面要約|general offer|mandatory unconditional cash offer|\bgo "),
    ("inside_information", r"內幕消息|inside information"),
    ("change_company_name", r"更改公司名稱|change of company name|change.*name"),
    ("board_change", r"董事|director|board"),
    ("trading_halt", r"停牌|暫停買賣|trading halt|suspension"),
    ("resumption", r"復牌|恢復買賣|resumption"),
    ("capital_reorganisation", r"股本重組|capital reorganisation|capital restructuring|capital reorganization"),
    ("general_offer", r"要約|takeover|takeovers code"),
    ("convertible_bonds", r"可換股債券|可轉換債券|convertible bond|convertible note|cb\b"),
    ("very_substantial_acquisition", r"非常重大收購|very substantial acquisition|vsa\b"),
    ("resumption_of_public_float", r"公眾持股|public float|恢復公眾持股"),
    ("high_concentration_warning", r"股權高度集中|high(?:ly)? concentrat|concentration of shareholding"),
    ("results_announcement", r"業績|年報|中期報告|annual result|interim result|final result"),
]

# Error code of a failed fetch by the first rule of which the text contains a phrase.
ERROR_RULES = [
    ("COLD_START", ["timeoutbudget", "budget exhausted"]),
    ("SOURCE_TIMEOUT", ["timeout", "timed out"]),
    ("SOURCE_CHALLENGE", ["source_challenge", "cookie/reload challenge", "human verification"]),
    ("SOURCE_CHANGED", ["no table", "no matching table", "table format"]),
    ("PARSE_ERROR", ["parsing failed", "parse"]),
    ("SOURCE_FETCH_FAILED", ["connection", "dns", "name resolution", "refused", "reset", "402", "403", "429", "502", "503", "504", "forbidden"]),
]
RETRYABLE = ["COLD_START", "SOURCE_TIMEOUT", "SOURCE_FETCH_FAILED", "ISSUE_LOOKUP_FAILED"]

# Phrases of a Big Changes error that is only a gap in history.
HISTORY_GAP = ["local history", "not enough sdw snapshots", "mirror historical data", "big changes require"]


def contains_any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def category_by_keyword(name: Column, rules=CATEGORY_BY_KEYWORD) -> Column:
    """The category of the first keyword that the upper-case name contains; null if none is."""
    upper, out = F.upper(F.coalesce(name, F.lit(""))), None
    for category, keywords in rules:
        hit = contains_any(upper, keywords)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out


def categories(spark: SparkSession, by_id=None) -> DataFrame:
    """The id table: participant_id, category."""
    return spark.createDataFrame(list((by_id or CATEGORY_BY_ID).items()), "participant_id string, by_id string")


def with_category(participants: DataFrame, by_id=None, by_keyword=CATEGORY_BY_KEYWORD) -> DataFrame:
    """Add `category`: by exact id, else by name, else bank for ids that begin with C, else unknown.

    The id table is a fixed configuration of a few rows, so it is broadcast. Apply to distinct participants and join the
    result to holdings.
    """
    ids = F.broadcast(categories(participants.sparkSession, by_id))
    pid = F.upper(F.trim("participant_id"))
    known = participants.join(ids.withColumnRenamed("participant_id", "known_id"), pid == F.col("known_id"), "left")
    other = F.when(pid.startswith("C"), "bank").otherwise("unknown")
    return known.withColumn("category", F.coalesce("by_id", category_by_keyword(F.col("participant_name"), by_keyword), other)).drop("by_id", "known_id")


#: Characters of the grams by which keywords are found in names.
GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """The distinct runs of `size` characters of a text; none if it is shorter."""
    return F.array_distinct(F.transform(F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, size)))


def first_keywords(names: DataFrame, by_keyword: DataFrame) -> DataFrame:
    """name and the category of the keyword of least priority that the upper-case name contains; names without one are left out.

    An inverted index: each keyword stands under the rarest of its grams of GRAM characters (shorter keywords under
    themselves), rarest among the names at hand; a name meets the keywords that stand under its own grams, and what it
    really contains decides. Keywords inside a word are found like others. A keyword whose rarest gram is in no name
    goes before the join.
    """
    rows = names.select(F.upper(F.coalesce("name", F.lit(""))).alias("upper_name")).distinct()
    rules = by_keyword.select("priority", F.upper(F.trim("keyword")).alias("keyword"), "category").filter("keyword <> ''")
    size = F.least(F.length("keyword"), F.lit(GRAM))
    of_rules = rules.select("priority", "keyword", "category", F.explode(_grams(F.col("keyword"), size)).alias("gram"))
    of_names = rows.select("upper_name", F.explode(F.flatten(F.transform(F.array(*(F.lit(n) for n in range(1, GRAM + 1))), lambda n: _grams(F.col("upper_name"), n)))).alias("gram"))
    # grams of names that no keyword has are of no use
    useful = of_names.join(of_rules.select("gram").distinct(), "gram", "left_semi")
    often = useful.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    known = of_rules.join(often, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    index = known.groupBy("priority", "keyword", "category").agg(F.min(F.struct("n", "gram")).alias("rarest")).filter("rarest.n > 0")
    met = useful.join(index.select("priority", "keyword", "category", "rarest.gram"), "gram").filter(F.contains("upper_name", "keyword"))
    return met.groupBy("upper_name").agg(F.min_by("category", F.struct("priority", "keyword")).alias("category"))


def with_category_by(participants: DataFrame, by_id: DataFrame, by_keyword: DataFrame) -> DataFrame:
    """with_category() for rules that are tables, as read_category_rules gives them, of any size: nothing is collected.

    by_id: participant_id, category; by_keyword: priority (the least counts), keyword, category. Of several rules for an
    id the least category counts.
    """
    ids = by_id.groupBy(F.upper(F.trim("participant_id")).alias("_id")).agg(F.min("category").alias("_by_id"))
    words = first_keywords(participants.select(F.col("participant_name").alias("name")), by_keyword).select(F.col("upper_name").alias("_name"), F.col("category").alias("_by_name"))
    pid = F.upper(F.trim("participant_id"))
    known = participants.join(ids, pid == F.col("_id"), "left").join(words, F.upper(F.coalesce("participant_name", F.lit(""))) == F.col("_name"), "left")
    other = F.when(pid.startswith("C"), "bank").otherwise("unknown")
    return known.withColumn("category", F.coalesce("_by_id", "_by_name", other)).drop("_id", "_by_id", "_name", "_by_name")


def reason_tags(reason: Column, rules=REASON_TAGS) -> Column:
    """The tags whose needles a reason contains, in the order of the rules."""
    text = F.coalesce(reason, F.lit(""))
    return F.array_compact(F.array(*(F.when(contains_any(text, needles), tag) for tag, needles in rules)))


#: Signs that make an alternative of a pattern more than a literal.
_SIGNS = re.compile(r"[\\^$.|?*+()\[\]{}]")


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between its outermost bars."""
    parts, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _needed(alternative: str) -> str:
    """The longest literal that a text must hold for an alternative to match: a group and what is optional don't count."""
    bare = re.sub(r"\\.", "\0", re.sub(r"\([^()]*\)[?*]?|.[?*]", "\0", alternative))
    return max(re.split(r"[\0^$.|?*+()\[\]{}]", bare), key=len)


@lru_cache(maxsize=8)
def _automaton(needles: tuple[str, ...]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for needle in needles:
        made.add_word(needle, needle)
    made.make_automaton()
    return made


def literals_in(text: Column, needles: list[str]) -> Column:
    """The distinct needles that a text holds, overlapping ones too, in no order: one pass, whatever their number (Aho-Corasick).

    Texts leave the Arrow batch one at a time, so Python holds the batch (of at most the bytes and rows that are set) and one text.
    """
    wanted = tuple(sorted(set(needles)))

    def scan(texts: pa.Array) -> pa.Array:
        found = _automaton(wanted).iter
        each = (t.as_py() for t in texts)
        return pa.array(([*{hit for _, hit in found(t)}] if t else [] for t in each), pa.list_(pa.string()))

    return F.arrow_udf(scan, "array<string>")(text)


def event_tags(category: Column, title: Column, rules=EVENT_TAGS) -> Column:
    """The sorted distinct tags of an announcement.

    The literals of all rules are looked for in one pass over the text. Alternatives that aren't literals are looked at
    only in texts that hold their longest literal part.
    """
    by_tag: dict[str, list[str]] = {}
    special: list[tuple[str, str, str]] = []
    for tag, pattern in rules:
        for part in _alternatives(pattern):
            if _SIGNS.search(part):
                special.append((tag, part, _needed(part)))
            else:
                by_tag.setdefault(tag, []).append(part)
    needles = [*(x for literals in by_tag.values() for x in literals), *(need for _, _, need in special)]
    if not all(needles):
        raise ValueError("an alternative without a literal")

    def tags_of(text: Column, hits: Column) -> Column:
        found = [F.when(F.arrays_overlap(hits, F.array(*map(F.lit, literals))), tag) for tag, literals in by_tag.items()]
        found += [F.when(F.array_contains(hits, need) & text.rlike(f"(?U){part}"), tag) for tag, part, need in special]
        return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))

    text = F.lower(F.concat_ws(" ", F.coalesce(category, F.lit("")), F.coalesce(title, F.lit(""))))
    # text and hits are variables of a lambda, so that each is made once and not for each rule
    return F.transform(F.array(F.struct(text.alias("text"), literals_in(text, needles).alias("hits"))), lambda x: tags_of(x["text"], x["hits"]))[0]


def error_code(error_type: Column, message: Column, rules=ERROR_RULES) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(error_type, F.lit("")), F.coalesce(message, F.lit(""))))
    out = None
    for code, phrases in rules:
        hit = contains_any(text, phrases)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise("PARSE_ERROR")


def retryable(code: Column) -> Column:
    return code.isin(RETRYABLE)
