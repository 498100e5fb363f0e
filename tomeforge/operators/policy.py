"""Include and exclude policy of paths, with the rule that decided.

Rules are compiled on the driver to regular expressions; a decision is one column expression:
for each directory of the path from the top, and then for the path itself, the last rule
that matches. The first excluded directory decides, secrets decide before all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths left out without any configuration.
DEFAULTS = (
    ".git .hg .svn node_modules bower_components vendor __pycache__ .venv venv .pytest_cache .mypy_cache .ruff_cache .tox "
    ".cache target dist build out .next .nuxt .turbo .parcel-cache .docusaurus .tomeforge *.min.js *.min.css *.map *.log logs "
    "*.pyc *.class *.o *.so *.dll *.dylib *.exe *.bin .DS_Store Thumbs.db package-lock.json yarn.lock pnpm-lock.yaml "
    "Cargo.lock Gemfile.lock go.sum bun.lockb poetry.lock uv.lock composer.lock flake.lock"
).split()
# Secrets, which no include brings back, and templates that are none.
SECRETS = (
    ".env .env.* id_rsa id_dsa id_ecdsa id_ed25519 *.pem *.key *.p12 *.pfx *.keystore *.jks *.p7b *.gpg credentials.json "
    ".npmrc .netrc .htpasswd"
).split()
TEMPLATES = (".env.example", ".env.sample", ".env.template")


@dataclass(frozen=True)
class Rule:
    kind: str  # include, exclude, secret
    source: str
    raw: str
    base: str = ""

    @property
    def directory_only(self) -> bool:
        return self.raw.endswith("/")

    def regex(self) -> str:
        """On paths relative to the root: * stays within a name, ** spans them, other characters are literal."""
        body = self.raw.rstrip("/").lstrip("!")
        anchored = "/" in body
        parts = re.split(r"(\*\*/|\*\*|\*)", body.lstrip("/"))
        glob = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in parts)
        base = re.escape(self.base.rstrip("/") + "/") if self.base else ""
        return f"^{base}{'' if anchored else '(?:.*/)?'}{glob}$"


def rules(includes: list[str] = (), excludes: list[str] = (), native: list[tuple[str, list[str]]] = ()) -> list[Rule]:
    """Defaults, secrets, configured excludes and includes, then ignore files by depth; later rules win."""
    out = [Rule("exclude", "default", p) for p in DEFAULTS] + [Rule("secret", "secret", p) for p in SECRETS]
    out += [Rule("exclude", "config", p) for p in excludes] + [Rule("include", "config", p) for p in includes if p != "**"]
    for base, lines in sorted(native, key=lambda x: x[0].count("/") + bool(x[0])):
        for line in lines:
            if (line := line.rstrip()) and not line.startswith("#"):
                out.append(Rule("include" if line.startswith("!") else "exclude", f"ignore:{base}", line, base))
    return out


def _matching(path: Column, given: list[Rule], directory: bool) -> Column:
    """Numbers of the rules that match, ascending."""
    usable = [(i, r) for i, r in enumerate(given) if directory or not r.directory_only]
    return F.array_compact(F.array(*[F.when(path.rlike(r.regex()), F.lit(i)) for i, r in usable]))


def decision(path: Column, given: list[Rule]) -> Column:
    """(included, rule): the number of the rule that decided, null if none matched."""
    kinds = F.array(*[F.lit(r.kind) for r in given])
    plain = [r if r.kind != "secret" else Rule("secret", r.source, "\x00") for r in given]
    names = F.split(path, "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda n: F.array_join(F.slice(names, 1, n), "/"))
    parents = F.when(F.size(names) > 1, parents).otherwise(F.array().cast("array<string>"))
    last = lambda xs: F.get(xs, F.size(xs) - 1)
    out = lambda i: F.coalesce(F.get(kinds, i) == "exclude", F.lit(False))
    directories = F.filter(F.transform(parents, lambda d: last(_matching(d, plain, True))), out)
    secret = [(i, r) for i, r in enumerate(given) if r.kind == "secret"]
    named = F.element_at(names, -1)
    hit = F.coalesce(*[F.when(path.rlike(r.regex()), F.lit(i)) for i, r in secret], F.lit(None).cast("int"))
    hit = F.when(~named.isin(*TEMPLATES), hit)
    own = last(_matching(path, plain, False))
    rule = F.coalesce(hit, F.get(directories, 0), own)
    return F.struct((~F.coalesce(F.get(kinds, rule).isin("exclude", "secret"), F.lit(False))).alias("included"), rule.alias("rule"))


def skip_reason(size: Column, valid: Column, secret: Column, most: int = 1 << 20) -> Column:
    """Why an included file is skipped, null if it is not."""
    return F.when(size > most, "file_too_large").when(~valid, "not_utf8").when(secret, "secret_content")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
