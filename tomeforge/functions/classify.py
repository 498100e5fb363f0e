"""Language, role and lifecycle of a file, from its path and front matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of code and of configuration.
CODE = "rs ts tsx js jsx mjs cjs py go rb java c cc cpp h hpp cs kt swift php sh bash zsh ps1 sql lua pl".split()
CONFIG = "json yaml yml toml ini conf proto".split()
# Extensions of prose and their languages.
PROSE = {"md": "markdown", "mdx": "markdown", "rst": "restructuredtext", "adoc": "asciidoc", "txt": "text"}
# Names of instruction files.
INSTRUCTIONS = ("agents.md", "claude.md", "clinerules", "cursorrules", "copilot-instructions.md")
# Path components and the role and lifecycle they tell.
COMPONENTS = {
    "plans": ("plan", "proposed"), "plan": ("plan", "proposed"), "decisions": ("decision", "accepted"),
    "adr": ("decision", "accepted"), "execution": ("execution-record", "unknown"), "changelog": ("historical", "superseded"),
    "releases": ("historical", "superseded"), "archive": ("historical", "superseded"),
}
# Roles and lifecycles that front matter may name.
ROLES = ("current-doc", "instruction", "plan", "decision", "execution-record", "historical", "code", "config")
LIFECYCLES = ("proposed", "accepted", "implemented", "superseded", "unknown")
# Directories of copied test data.
FIXTURES = ("fixture", "fixtures", "testdata", "test-data", "test_data", "test_fixtures", "__fixtures__", "__snapshots__")


def extension(path: Column) -> Column:
    """Lower-case extension; names that start with their only dot have none."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def language(path: Column) -> Column:
    ext = extension(path)
    prose = F.create_map(*[F.lit(x) for pair in PROSE.items() for x in pair])
    return F.coalesce(F.try_element_at(prose, ext), F.when(ext.isin(CODE + CONFIG), ext), F.lit("text"))


def front_matter(content: Column) -> Column:
    """(role, status) of a closed block of --- lines at the very start; nulls without one."""
    block = F.regexp_extract(content, r"^[ \t]*---[ \t]*\r?\n((?s:.*?))(?:^|\n)[ \t]*---[ \t]*(?:\r?\n|$)", 1)
    lines = F.split(F.concat(F.lit("\n"), block), "\n")

    def value(key: str, allowed: tuple[str, ...]) -> Column:
        # the last line of a key counts, as read in order
        mine = F.filter(lines, lambda x: x.rlike(rf"^\s*(?:tomeforge-)?{key}\s*:"))
        text = F.btrim(F.trim(F.regexp_replace(F.get(mine, F.size(mine) - 1), r"^[^:]*:", "")), F.lit('"'))
        return F.when(text.isin(*allowed), text)

    return F.struct(value("role", ROLES).alias("role"), value("status", LIFECYCLES).alias("status"))


def inferred(path: Column) -> Column:
    """(role, lifecycle) from the path alone; the first telling component wins."""
    ext, name = extension(path), F.lower(F.substring_index(path, "/", -1))
    told = F.filter(F.split(F.lower(path), "/"), lambda c: c.isin(*COMPONENTS))
    pick = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in COMPONENTS.items() for x in (k, v[i])]), F.get(told, 0))
    special = [(name.isin(*INSTRUCTIONS), "instruction", "accepted"), (ext.isin(CODE), "code", "unknown"), (ext.isin(CONFIG), "config", "unknown")]
    role, life = F.coalesce(pick(0), F.lit("current-doc")), F.coalesce(pick(1), F.lit("unknown"))
    for test, r, x in reversed(special):
        role, life = F.when(test, r).otherwise(role), F.when(test, x).otherwise(life)
    return F.struct(role.alias("role"), life.alias("lifecycle"))


def classified(path: Column, content: Column) -> Column:
    """(role, lifecycle, source): front matter first, then the path."""
    front, guess = front_matter(content), inferred(path)
    told = front["role"].isNotNull() | front["status"].isNotNull()
    return F.struct(
        F.coalesce(front["role"], guess["role"]).alias("role"),
        F.when(told, F.coalesce(front["status"], F.lit("unknown"))).otherwise(guess["lifecycle"]).alias("lifecycle"),
        F.when(told, "explicit").otherwise("inferred").alias("source"),
    )


def is_fixture(path: Column) -> Column:
    return F.exists(F.split(F.lower(path), "/"), lambda c: c.isin(*FIXTURES))
