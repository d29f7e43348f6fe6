"""Web text: Markdown, links, URLs, reader output and JSON inside prose, as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of downloadable files.
DATA_FILES = ("csv", "tsv", "json", "jsonl", "parquet", "zip", "gz", "tgz", "tar", "bz2", "xz", "7z", "rar", "xls", "xlsx", "sqlite", "db", "arrow", "txt", "pdf")
#: Parts of a path that no download has.
PAGES = ("/issues", "/pull", "/discussions", "/wiki", "/blob/", "/login", "/signup", "/search")


def host(url: Column) -> Column:
    """The host of an absolute URL in lower case, without user and port; null without one."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def blocked(url: Column, domains: tuple[str, ...]) -> Column:
    """Whether the host holds one of the domains, as itself or within; false without a host."""
    hit = F.lit(False)
    for d in domains:
        hit = hit | F.coalesce(host(url).contains(d.lower()), F.lit(False))
    return hit


def download(url: Column) -> Column:
    """Whether a URL names a file to download, by its ending; query and fragment do not count. No request is made."""
    path = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "[?#].*$", ""))
    page = F.lit(False)
    for p in PAGES:
        page = page | path.contains(p)
    return path.rlike(rf"\.({'|'.join(DATA_FILES)})$") & ~page


def absolute(base: Column, link: Column) -> Column:
    """A link seen from a page: kept if absolute, else put on the page's scheme, host or folder; dot segments are resolved."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(base, "[?#].*$", "")
    path = F.substr(bare, F.length(root) + 1)
    folder = F.concat(root, F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)", 1)))
    made = (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(bare, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(link == "", base)
        .otherwise(F.concat(folder, link))
    )
    head = F.regexp_extract(made, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    rest = F.substr(made, F.length(head) + 1)
    query, segments = F.regexp_extract(rest, r"([?#].*)$", 1), F.split(F.regexp_replace(rest, r"[?#].*$", ""), "/")
    up = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    walked = F.aggregate(segments, F.array().cast("array<string>"), up)
    folded = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    dotted = rest.rlike(r"(^|/)\.{1,2}(/|$|[?#])")
    return F.when((head != "") & dotted, F.concat(head, F.array_join(folded, "/"), query)).otherwise(made)


def links(markdown: Column, limit: int = 50) -> Column:
    """Targets of Markdown links but for anchors, then plain URLs: distinct, in order, the first ``limit``."""
    targets = F.regexp_extract_all(markdown, F.lit(r"\]\(\s*([^)#\s][^)\s]*)"), F.lit(1))
    plain = F.regexp_extract_all(markdown, F.lit(r"(https?://[^\s)\]>\"']+)"), F.lit(1))
    return F.slice(F.array_distinct(F.concat(targets, plain)), 1, limit)


def code_blocks(markdown: Column, least: int = 20) -> Column:
    """array<struct<lang, code>>: fenced blocks of at least ``least`` characters; only without any, indented ones, whose language is empty."""
    fence = r"```([A-Za-z0-9_+#-]*)[ \t]*\n([\s\S]*?)```"
    pairs = F.zip_with(F.regexp_extract_all(markdown, F.lit(fence), F.lit(1)), F.regexp_extract_all(markdown, F.lit(fence), F.lit(2)), lambda a, b: F.struct(a.alias("lang"), F.trim(b, F.lit("\n \t")).alias("code")))
    fenced = F.filter(pairs, lambda x: F.length(x["code"]) >= least)
    runs = F.regexp_extract_all(markdown, F.lit(r"(?m)((?:^(?: {4}|\t).*(?:\n|\z))+)"), F.lit(1))
    plain = F.transform(runs, lambda x: F.struct(F.lit("").alias("lang"), F.trim(F.regexp_replace(x, r"(?m)^(?: {4}|\t)", ""), F.lit("\n")).alias("code")))
    return F.when(F.size(fenced) > 0, fenced).otherwise(F.filter(plain, lambda x: F.length(x["code"]) >= least))


def last_python(text: Column) -> Column:
    """The last fenced Python block; null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?i)```(?:python|py)[0-9]*[ \t]*\n([\s\S]*?)```"), F.lit(1)), F.lit(-1))


def with_imports(code: Column, prompt: Column) -> Column:
    """A program that begins with a function, behind what the prompt has before its own first ``def``; leading white space goes. Null stays null."""
    at = F.instr(F.coalesce(prompt, F.lit("")), "def")
    bare = F.regexp_replace(code, r"^\s+", "")
    bare_def = code.startswith("def") | code.startswith(" def")
    return F.when(bare_def & (at > 0), F.concat(F.substring(prompt, F.lit(1), at - 1), bare)).otherwise(bare)


def reader_page(raw: Column) -> Column:
    """struct<title, url, warning, content> of a page reader's output; without the content mark, all of it is content."""
    line = lambda name: F.nullif(F.trim(F.regexp_extract(F.regexp_replace(raw, r"(?s)Markdown Content:.*$", ""), rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))
    mark = F.instr(raw, "Markdown Content:")
    content = F.when(mark > 0, F.substr(raw, mark + F.lit(len("Markdown Content:")))).otherwise(raw)
    return F.struct(line("Title").alias("title"), line("URL Source").alias("url"), line("Warning").alias("warning"), F.trim(content, F.lit("\n \t\r")).alias("content"))


def json_in(text: Column) -> Column:
    """The JSON value inside a model's reply: fences go; else from the first to the last brace, else bracket; null if nothing parses."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", ""))
    tries = [bare, F.regexp_extract(text, r"(\{[\s\S]*\})", 1), F.regexp_extract(text, r"(\[[\s\S]*\])", 1)]
    sound = lambda s: F.when(s.rlike(r"^\s*[\[{]"), F.try_parse_json(s))
    return F.coalesce(*[F.to_json(sound(s)) for s in tries])


def dataset_reference(text: Column) -> Column:
    """owner/name of a dataset page's URL of the form ``.../datasets/owner/name``; null without one."""
    return F.nullif(F.regexp_extract(text, r"/datasets/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)", 1), F.lit(""))
