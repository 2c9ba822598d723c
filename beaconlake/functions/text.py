"""Text operators as Column functions; every one works on the whole text."""
from pyspark.sql import functions as F

from beaconlake import lexicon as lx
from beaconlake.functions.numeric import lookup

EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]"

# Markup patterns, in the order they are taken out.
INLINE_MARKUP = [(r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1"),
                 (r"`{1,3}([^`]*)`{1,3}", "$1"), (r"(?dm)^\s{0,3}#{1,6}\s*", "")]
FLAT_MARKUP = [(r"(?dm)^\s{0,3}>\s?", ""), (r"(?dm)^\s{0,3}[-*+]\s+", ""),
               (r"\*{1,3}([^*]+)\*{1,3}", "$1")]
LINE_MARKUP = [(r"(?dm)^\s*[-*_=]{3,}\s*$", ""), (r"(?dm)^\s{0,3}>\s?", ""),
               (r"\*{1,3}([^*]+)\*{1,3}", "$1")]
LEFTOVERS = [("**", ""), ("##", ""), ("```", ""), ("`", "")]


def _regex_chain(col, rules):
    for pattern, replacement in rules:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def _without_leftovers(col):
    for mark, replacement in LEFTOVERS:
        col = F.replace(col, F.lit(mark), F.lit(replacement))
    return F.regexp_replace(col, EMOJI, "")


def trim_space(col):
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def one_line(col):
    return trim_space(F.regexp_replace(col, r"\s+", " "))


def strip_markdown(col):
    """Markdown to one plain line."""
    return one_line(_without_leftovers(_regex_chain(F.coalesce(col, F.lit("")), INLINE_MARKUP + FLAT_MARKUP)))


def clean_lines(col):
    """Markdown to plain text that keeps its line structure."""
    col = _without_leftovers(_regex_chain(F.coalesce(col, F.lit("")), INLINE_MARKUP + LINE_MARKUP))
    return trim_space(_regex_chain(col, [(r"[ \t]+", " "), (r"\n{3,}", "\n\n")]))


def plain_dashes(col):
    for mark, replacement in ((" — ", ", "), ("—", ", "), ("–", "-")):
        col = F.replace(col, F.lit(mark), F.lit(replacement))
    return col


def house_style(col, cap, marks="*#`"):
    """No markdown marks, no long dashes, single spaces, at most `cap` characters."""
    bare = F.regexp_replace(F.coalesce(col, F.lit("")), "[" + marks + "]+", "")
    return F.substring(one_line(plain_dashes(bare)), 1, cap)


def has_any(text, phrases):
    """True when the text contains one of the fixed phrases."""
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def terms(title, tags):
    """Words of the title plus whole tags, without boilerplate; repeats are kept."""
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"[a-z][a-z0-9+#.]{2,}"), F.lit(0))
    words = F.transform(words, lambda w: F.btrim(w, F.lit(".")))
    whole = F.transform(tags, lambda t: F.trim(F.lower(t)))
    keep = lambda w: (F.length(w) >= 3) & ~w.isin(*lx.TERM_STOP)
    return F.concat(F.filter(words, keep), F.filter(whole, keep))


def title_keywords(title):
    """First five distinct words of a title that say something."""
    words = F.regexp_extract_all(title, F.lit(r"[A-Za-z][A-Za-z0-9+#.]{2,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~F.lower(w).isin(*lx.KEYWORD_STOP))), 1, 5)


def issue_quality(source, body):
    """How well an issue is written up, 0..1; 0.5 where the notion does not apply."""
    low = F.lower(body)
    flag = lambda cond, w: F.when(cond, w).otherwise(0.0)
    total = (F.least(F.lit(0.35), F.length(body) / 1200.0 * 0.35)
             + flag(F.contains(body, F.lit("```")), 0.15)
             + flag(body.rlike(r"(?dm)^\s*(\d+\.|[-*])\s"), 0.15)
             + flag(body.rlike(r"https?://"), 0.10)
             + flag(has_any(low, lx.REPRO_WORDS), 0.15)
             + flag(has_any(low, lx.NEWCOMER_WORDS), 0.10))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    return F.when((source != "github") | body.isNull() | (body == ""), 0.5).otherwise(score)


def good_first(tags):
    return F.exists(tags, lambda t: has_any(F.lower(F.coalesce(t, F.lit(""))), lx.GOOD_FIRST_WORDS))


def repo_of_page(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"github\.com/([^/]+/[^/]+)", 1)


def repo_of_api(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"repos/([^/]+/[^/]+)$", 1)


def name_and_role(full):
    """Split "name <dash> role" at the first em dash, else spaced hyphen, else en dash."""
    def cut(sep):
        at = F.instr(full, sep)
        return F.struct(F.trim(full.substr(F.lit(1), at - 1)).alias("name"),
                        F.trim(full.substr(at + len(sep), F.length(full))).alias("role"))
    whole = F.struct(F.trim(full).alias("name"), F.lit("").alias("role"))
    return (F.when(F.contains(full, F.lit("—")), cut("—"))
            .when(F.contains(full, F.lit(" - ")), cut(" - "))
            .when(F.contains(full, F.lit("–")), cut("–")).otherwise(whole))


def display_name(name):
    """Single-spaced, at most 60 characters, each word capitalized; 'Guest' when empty."""
    short = F.substring(one_line(F.coalesce(name, F.lit(""))), 1, 60)
    return F.when(short == "", "Guest").otherwise(F.initcap(short))


def slug(text, fallback):
    dashed = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.substring(dashed, 1, 20)
    return F.when(cut == "", F.lit(fallback)).otherwise(cut)


def display_title(title, body):
    """The title, or the first 90 characters of the single-spaced body."""
    head = trim_space(F.coalesce(title, F.lit("")))
    return F.when(head != "", head).otherwise(F.substring(one_line(F.coalesce(body, F.lit(""))), 1, 90))


def pair_text(title, body, cap=400):
    whole = F.concat(trim_space(F.coalesce(title, F.lit(""))), F.lit(" "), F.coalesce(body, F.lit("")))
    return F.substring(trim_space(whole), 1, cap)


def domain_label(key):
    title = F.initcap(F.replace(F.coalesce(key, F.lit("")), F.lit("_"), F.lit(" ")))
    return F.coalesce(lookup(key, lx.DOMAIN_LABELS), title)


def effort_basis(source, kind, minutes):
    """One sentence on where a time estimate comes from. Fixed texts."""
    lead = F.concat(F.lit("~"), minutes.cast("string"), F.lit(" min"))
    issue = F.when(minutes < 120, "a beginner-friendly issue (a 45-min base)").otherwise(
        "a standard issue (a 150-min base)")
    return (F.when((source == "github") & (kind == "pull_request"), F.concat(lead, F.lit(
        ": reviewing and iterating on a pull request (about a 90-min base, plus the size of the change).")))
        .when(source == "github", F.concat(lead, F.lit(", from a transparent heuristic: "), issue, F.lit(
            ", plus reading time scaled to the issue's length. GitHub work is the heaviest category, "
            "so the estimate is deliberately generous.")))
        .when(source.isin("hackernews", "reddit"), F.concat(lead, F.lit(
            ": time to read the thread and write one substantive, non-obvious comment.")))
        .when(source == "bluesky", F.concat(lead, F.lit(": read the post and write a thoughtful reply.")))
        .when(source == "devto", F.concat(lead, F.lit(
            ": the article's reading time plus ~8 min to leave a comment that adds value.")))
        .otherwise(F.concat(lead, F.lit(" to meaningfully engage."))))


def experience(blob):
    """newbie, expert or mid, read from a persona's own words."""
    low = F.lower(blob)
    return F.when(has_any(low, lx.NEWBIE_WORDS), "newbie").when(
        has_any(low, lx.EXPERT_WORDS), "expert").otherwise("mid")


def engagement_mode(persona_id, goal_and_interests, first_platform):
    """The reason a persona engages: pinned ids, then goal words, then main platform."""
    low = F.lower(goal_and_interests)
    on_github = F.lower(F.coalesce(first_platform, F.lit(""))) == "github"
    expr = F
    for piece, mode in lx.PINNED_MODES:
        expr = expr.when(F.contains(F.lower(persona_id), F.lit(piece)), mode)
    return (expr.when(has_any(low, lx.MONITOR_WORDS), "monitor")
            .when(has_any(low, lx.PROMOTE_WORDS), "promote")
            .when(has_any(low, lx.CONTRIBUTE_WORDS) & on_github, "contribute")
            .when(has_any(low, lx.DISCUSS_WORDS), "discuss")
            .when(on_github, "contribute").otherwise("discuss"))


def domain_phrase(domains):
    """Up to three domain labels as "a, b and c"."""
    labels = F.transform(F.slice(domains, 1, 3), domain_label)
    n = F.size(labels)
    head = F.array_join(F.slice(labels, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return (F.when(n == 0, "a broad range of technology").when(n == 1, labels.getItem(0))
            .otherwise(F.concat(head, F.lit(" and "), F.try_element_at(labels, F.lit(-1)))))


def plan_read(mode, level, domains, hours, avoid):
    """The deterministic summary of a weekly plan. Fixed texts."""
    skip = F.regexp_replace(F.trim(F.coalesce(avoid, F.lit(""))), r"\.+$", "")
    return F.concat(
        F.lit("You want to "), lookup(mode, lx.MODE_VERBS, "engage where it counts"),
        F.lit(", focused on "), domain_phrase(domains), F.lit(". "),
        lookup(level, lx.EXPERIENCE_CLAUSES, ""), F.lit("With about "), hours.cast("string"),
        F.lit(" hours a week, here is a mix that puts your time where it counts"),
        F.when(skip != "", F.concat(F.lit(", and steers clear of "), skip, F.lit("."))).otherwise(F.lit(".")),
        F.lit(" Move any slider, or set one to zero to drop it."))


def keyword_grade(source, language, excluded, item_domains, whitelist, text, keywords):
    """Relevance grade 0, 1 or 2 from domains, keywords and language limits only."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.exists(keywords, lambda k: F.contains(low, k))
    same = F.arrays_overlap(item_domains, whitelist)
    barred = (source == "github") & F.array_contains(excluded, F.lower(F.coalesce(language, F.lit(""))))
    return (F.when(barred, 0).when(F.size(whitelist) == 0, F.when(hit, 2).otherwise(1))
            .when(same & hit, 2).when(same | hit, 1).otherwise(0))


def valid_topic(tag):
    """A tag that can stand as a subtopic."""
    return ((F.length(tag) >= 3) & (F.length(tag) <= 20) & ~tag.isin(*lx.TOPIC_STOP)
            & ~tag.rlike("[&!:/]") & ~tag.rlike("^(missing|level|size|dco|status)")
            & ~tag.rlike("(-classification|-review|-program)$")
            & ~F.contains(tag, F.lit("news -")) & ~tag.rlike("^[0-9]+$"))


def names_domain(tag, domain):
    """True when a tag only repeats its domain's own name."""
    label = F.lower(domain_label(domain))
    own = F.concat(F.regexp_extract_all(label, F.lit("[a-z0-9]+"), F.lit(0)),
                   F.array(F.replace(label, F.lit(" "), F.lit("")),
                           F.replace(domain, F.lit("_"), F.lit(""))))
    packed = F.replace(F.replace(tag, F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))
    return F.array_contains(own, tag) | F.array_contains(own, packed)
