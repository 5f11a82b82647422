"""Scalar functions on file paths and commit subjects."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and names of each comment family.
LANGUAGES = {
    "c": (
        ".go", ".java", ".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx", ".cs", ".js", ".jsx", ".mjs", ".cjs", ".ts",
        ".tsx", ".rs", ".swift", ".kt", ".kts", ".scala", ".sc", ".dart", ".php", ".m", ".mm", ".groovy", ".gradle",
    ),
    "python": (".py", ".pyw", ".pyi"),
    "ruby": (".rb", ".rbi", ".rake"),
    "hash": (
        ".sh", ".bash", ".zsh", ".fish", ".ksh", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".tf", ".tfvars", ".hcl",
        ".pl", ".pm", ".r",
    ),
    "html": (".html", ".htm", ".xml", ".vue", ".svelte", ".xhtml"),
    "sql": (".sql",),
    "lua": (".lua",),
    "haskell": (".hs", ".lhs", ".elm"),
    "prose": (".md", ".markdown", ".mdx", ".txt", ".rst", ".adoc", ".asciidoc", ".tex", ".org"),
}
HASH_NAMES = ("dockerfile", "makefile", "gemfile", "rakefile", "brewfile", "procfile", "vagrantfile")
FIX_SUBJECT = r"(?i)^[^\w]*(?:\[?\s*(?:fix|revert|hotfix)\s*\]?[:/\s])"


def dir_of(path: Column) -> Column:
    """The directory, "" for a file at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def base_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ext_of(path: Column) -> Column:
    """From the last dot of the file name on, lower-cased; "" without a dot."""
    return F.lower(F.regexp_extract(base_of(path), r"(\.[^.]*)$", 1))


def _first_dirs(path: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(dir_of(path), "/"), 1, n), "/")


def module_of(path: Column) -> Column:
    """First two directories; "." at the root."""
    return F.when(dir_of(path) == "", F.lit(".")).otherwise(_first_dirs(path, 2))


def risk_module_of(path: Column) -> Column:
    """First two directories; null at the root."""
    return F.when(dir_of(path) != "", _first_dirs(path, 2))


def sample_stratum(path: Column) -> Column:
    """First three directories; "." at the root."""
    return F.when(dir_of(path) == "", F.lit(".")).otherwise(_first_dirs(path, 3))


def glob_to_regex(pattern: str) -> str:
    """A shell glob as a regular expression: * and ? stay within a path component, [...] is a class."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            out.append("[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append(re.sub(r"([.+^$(){}|\[\]\\])", r"\\\1", ch))
        i += 1
    return "".join(out)


def _any(conditions) -> Column:
    return reduce(or_, conditions, F.lit(False))


def matches_any(path: Column, patterns) -> Column:
    """Whether some glob matches the whole path or the file name."""
    whole = "^(" + "|".join(map(glob_to_regex, patterns)) + ")$"
    return (path.rlike(whole) | base_of(path).rlike(whole)) if patterns else F.lit(False)


def architecture_regex(patterns) -> str:
    """All architecture patterns as one expression: directories anywhere, globs on a path suffix or a component."""
    out = []
    for p in patterns:
        p = p.removeprefix("*/")
        if p.endswith("/"):
            out.append("(^|/)" + glob_to_regex(p[:-1]).replace("[^/]*", "\\*") + "/")
        elif "/" in p:
            out.append("(^|/)" + glob_to_regex(p) + "$")
        else:
            out.append("(^|/)" + glob_to_regex(p) + "(/|$)")
            if "*" not in p:
                out.append(glob_to_regex(p))
    return "|".join(out)


def is_architecture(path: Column, patterns) -> Column:
    return path.rlike(architecture_regex(patterns)) if patterns else F.lit(False)


def has_extension(path: Column, patterns) -> Column:
    """"*.ext" tests the end of the path, anything else tests for a substring."""
    return _any(path.endswith(p[1:]) if p.startswith("*") else path.contains(p) for p in patterns)


_TEST_BASES = r"_test\.go$|^test_.*\.py$|_test\.py$|_(spec|test)\.rb$|^Test.*\.(java|kt|scala)$|(Test|Tests|Spec|IT)\.(java|kt|scala)$"
_TEST_DIRS = r"(^|/)(tests?|__tests__|spec)/"


def is_test_file(path: Column) -> Column:
    base = base_of(path)
    script = base.rlike(r"\.(test|spec)\.") & base.rlike(r"\.(ts|tsx|js|jsx|mjs|cjs)$")
    return base.rlike(_TEST_BASES) | script | path.rlike(_TEST_DIRS)


def test_siblings(path: Column) -> Column:
    """The nine names under which a test of this file would stand beside it; none without an extension."""
    base, ext = base_of(path), F.regexp_extract(base_of(path), r"(\.[^.]*)$", 1)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    at = F.concat(F.when(dir_of(path) == "", F.lit(".")).otherwise(dir_of(path)), F.lit("/"))
    # Taken apart once and not for each of the names.
    taken = F.array(F.struct(at.alias("at"), stem.alias("stem"), ext.alias("ext")))
    shapes = [("", "_test"), ("", ".test"), ("", ".spec"), ("test_", ""), ("", "_spec"), ("", "Test"), ("", "Tests"), ("", "Spec"), ("Test", "")]
    names = lambda x: F.array(*(F.concat(x["at"], F.lit(a), x["stem"], F.lit(z), x["ext"]) for a, z in shapes))
    return F.flatten(F.transform(F.filter(taken, lambda x: x["ext"] != ""), names))


def detect_lang(path: Column) -> Column:
    """The comment family of a file: of its extension, else of its name, else "unknown"."""
    pairs = [(e, lang) for lang, exts in LANGUAGES.items() for e in exts]
    known = F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    return F.coalesce(
        F.try_element_at(known, ext_of(path)),
        F.when(F.lower(base_of(path)).isin(*HASH_NAMES), F.lit("hash")),
        F.lit("unknown"),
    )


def resolve_rename(path: Column) -> Column:
    """The new side of `a/{x => y}/f` and `x => y`; other paths stay."""
    braces = r"^([^{]*)\{((?:(?! => )[^}])*) => ([^}]*)\}(.*)$"
    joined = F.regexp_replace(path, braces, "$1$3$4")
    joined = F.regexp_replace(F.regexp_replace(joined, "/+", "/"), "/$", "")
    return (
        F.when(~path.contains(" => "), path)
        .when(path.rlike(braces), joined)
        .otherwise(F.regexp_replace(path, "^(?:(?! => ).)* => ", ""))
    )


def is_fix(subject: Column) -> Column:
    return subject.rlike(FIX_SUBJECT) | subject.contains("修正")


def normalize_domain(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low == "", F.lit("Unknown"))
        .when(low.isin("backend", "be"), F.lit("BE"))
        .when(low.isin("frontend", "fe"), F.lit("FE"))
        .when(low.isin("infra", "infrastructure"), F.lit("Infra"))
        .when(low.isin("firmware", "fw"), F.lit("FW"))
        .otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name))))
    )


def norm_name(c: Column) -> Column:
    return F.lower(F.trim(c))
