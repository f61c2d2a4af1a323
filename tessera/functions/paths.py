"""What a file's path tells about it, as Column expressions: role, tier, entry-point rank, production scope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns over lower-case paths, the first that matches decides; and the names they stand for.
CONFIG_NAMES = [
    "package.json", "tsconfig.json", "tsconfig.base.json", ".eslintrc", ".eslintrc.json", ".eslintrc.js", ".prettierrc",
    ".prettierrc.json", "turbo.json", "pnpm-workspace.yaml", ".env", ".env.example", ".env.local", "dockerfile",
    "docker-compose.yml", "docker-compose.yaml",
]
UI_EXTENSION = r"\.(astro|tsx|jsx|vue|svelte)\z"
CODE = r"\.[cm]?[jt]sx?\z"
ROLES = [
    ("test", r"(^|/)(__tests?__|fixtures?|tests?|mocks?|stubs?)(/|\z)|\.(test|spec)" + CODE + r"|(^|/)(vitest|jest)\.setup\.[cm]?[jt]s\z"),
    ("documentation", r"\.(md|mdx|txt)\z|(^|/)(docs?|wiki|changelogs?)(/|\z)|(^|/)(contributing|license|readme)\z|(openapi|swagger)\.(json|yaml|yml)\z"),
    ("config", r"\.config" + CODE + r"|(^|/)configs?(/|\z)|(^|/)\.env(\.[^/]*)?\z"),
    ("cli-command", r"(^|/)(commands?|bin)(/|\z)|(^|/)src/(cli|main)\.[cm]?[jt]s\z"),
    ("api-handler", r"/app/.*/route" + CODE + r"|/pages/api/|(^|/)(src/routers?|routes?|controllers?)(/|\z)|\.(controller|handler|router)" + CODE),
    ("service", r"(^|/)src/(services?|usecases?|use-cases?|domain|application|actions?)(/|\z)|(^|/)(services?|usecases?)(/|\z)|\.(service|usecase|use-case|action)" + CODE),
    ("middleware", r"(^|/)src/(middlewares?|guards?|interceptors?)(/|\z)|(^|/)(middleware|proxy)" + CODE + r"|\.(middleware|guard|interceptor)" + CODE),
    ("repository", r"(^|/)src/(repositor(y|ies)|repositorie|repos?|daos?|data-access|db|database)(/|\z)|(^|/)repositories?(/|\z)|\.(repository|repo)" + CODE + r"|(^|/)src/lib/(prisma|db|database)" + CODE),
    ("ui-component", UI_EXTENSION),
    ("ai-integration", r"(^|/)ai(/|\z)|(^|/)src/lib/(openai|groq|anthropic|gemini|langchain|ai)" + CODE + r"|(^|/)src/(llm|prompts?)(/|\z)|\.(prompt|chain)" + CODE),
]
LANDING = r"(^|/)(landing|marketing)(/|\z)|(^|/)src/pages/index\.(astro|tsx?|jsx?)\z|(^|/)src/app/page\.(tsx?|jsx?)\z|(^|/)(hero|pricing|testimonials?|features?section|cta|banner|showcase)[^/]*\.(astro|tsx?|jsx?|vue|svelte)\z"
TIERS = [
    ("excluded", r"/(prisma/)?migrations?/|\.sql\z|/generated/|\.generated\.|\.(lock|log|map)\z"),
    ("reference", r"(^|/)schema\.prisma\z|\.(config|conf)\.[cm]?[jt]s\z"),
    ("primary", r"/(api|routes?)/|\.(service|usecase|action|route|handler)" + CODE + r"|/(hooks?|stores?)/"),
    ("supporting", CODE),
]
ENTRY_RANKS = [
    (100, r"/(utils?|helpers?|constants?|types?|shared)" + CODE),
    (100, r"\.d\.ts\z"),
    (5, r"/(route|handler)" + CODE),
    (10, r"/api/"),
    (20, r"\.(service|usecase|action)" + CODE),
    (25, r"/services?/"),
    (15, r"/(commands?|bin)/"),
    (30, r"/(pages?|app)/.+/(page|layout)" + CODE),
    (50, r"/components?/"),
    (60, r"/lib/"),
]
NON_PRODUCTION = ["__fixtures__", "__mocks__", "__tests__", "coverage", "demo", "docs", "example", "examples", "fixtures", "samples", "test", "tests"]
SOURCE = r"\.[cm]?[jt]sx?\z|\.vue\z|\.svelte\z|\.astro\z"
ENTRY = r"(^|/)(page|layout)\.[jt]sx?\z|(^|/)middleware\.[jt]s\z|(^|/)(server|app|index|main)" + CODE + r"|(^|/)route\.[jt]s\z"
ARCHITECTURAL = ["api-handler", "service", "middleware", "repository", "ui-component", "ai-integration", "cli-command"]


def first_match(text: Column, rules: list[tuple], otherwise) -> Column:
    """The value of the first rule whose pattern is found."""
    out = F.when(F.lit(False), F.lit(rules[0][0]))
    for value, pattern in rules:
        out = out.when(text.rlike(pattern), value)
    return out.otherwise(otherwise)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def role(path: Column) -> Column:
    """One of twelve architectural roles."""
    p = F.lower(path)
    out = F.when(p.rlike(ROLES[0][1]), ROLES[0][0]).when(p.rlike(ROLES[1][1]), ROLES[1][0])
    out = out.when(file_name(p).isin(CONFIG_NAMES) | p.rlike(ROLES[2][1]), "config").when(p.rlike(UI_EXTENSION) & p.rlike(LANDING), "landing-ui")
    for name, pattern in ROLES[3:]:
        out = out.when(p.rlike(pattern), name)
    return out.otherwise("application-source")


def tier(path: Column) -> Column:
    return first_match(F.lower(path), TIERS, "reference")


def entry_rank(path: Column) -> Column:
    """Low is a better entry point; 90 and more is none."""
    p = F.lower(path)
    plain_index = p.rlike(r"/index" + CODE) & ~p.rlike(r"/(api|routes?|commands?)/")
    return F.when(p.rlike(ENTRY_RANKS[0][1]), 100).when(plain_index, 95).otherwise(first_match(p, ENTRY_RANKS[1:], 70))


def is_production(path: Column) -> Column:
    p = F.lower(path)
    return ~F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, NON_PRODUCTION))) & ~p.rlike(r"\.(test|spec)\.[jt]sx?\z")


def is_source(path: Column) -> Column:
    return path.rlike(SOURCE)


def route_path(segments: Column) -> Column:
    """A URL path of folder names: (group) and @slot folders drop out."""
    kept = F.filter(segments, lambda s: (s != "") & ~s.rlike(r"^\(.*\)\z|^@"))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))
