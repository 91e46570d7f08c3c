"""Which records a search may return: platforms, cross-platform tools, pipelines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrove import lexicon
from lexigrove.options import Options

# Names that count as a platform, and prefixes that do.
VARIANTS = {"windows": (["cmd", "powershell", "windows-cmd", "windows-powershell"], "windows"), "macos": (["darwin"], "macos"), "linux": (["unix", "bash", "zsh"], "linux")}
CROSS = "cross-platform"


def is_variant(p: Column, wanted: str) -> Column:
    """A platform entry that stands for ``wanted``."""
    if wanted not in VARIANTS:
        return F.lit(False)
    names, prefix = VARIANTS[wanted]
    return F.lower(p).isin(*names) | F.lower(p).startswith(prefix)


def compatible(platforms: Column, wanted: str) -> Column:
    """No platforms, cross-platform, the platform itself or a variant."""
    return (F.size(platforms) == 0) | F.exists(platforms, lambda p: F.lower(p).isin(CROSS, wanted.lower()) | is_variant(p, wanted))


def compatible_without_cross(platforms: Column, wanted: str) -> Column:
    """As compatible(), but cross-platform entries do not count."""
    return (F.size(platforms) == 0) | F.exists(platforms, lambda p: (F.lower(p) != CROSS) & ((F.lower(p) == wanted.lower()) | is_variant(p, wanted)))


def is_cross_platform_tool(command: Column) -> Column:
    """P5: the command is one of the tools, or starts with one and a space."""
    return F.split(F.lower(command), " ", 2)[0].isin(*lexicon.CROSS_PLATFORM_TOOLS)


def is_pipeline(command: Column, flag: Column) -> Column:
    """P7"""
    out = flag
    for part in ("|", "&&", ">>"):
        out = out | F.contains(command, F.lit(part))
    return out | F.contains(F.lower(command), F.lit("pipe"))


def platform_ok(options: Options) -> Column:
    """P1, over the columns platform and command."""
    if options.all_platforms:
        return F.lit(True)
    wanted = options.platforms or (options.current_platform,)
    check = compatible_without_cross if options.no_cross_platform else compatible
    out = F.lit(False)
    for w in wanted:
        out = out | check(F.col("platform"), w)
    if not options.no_cross_platform:
        out = out | compatible(F.col("platform"), CROSS) | is_cross_platform_tool(F.col("command"))
    return out


def eligible(options: Options) -> Column:
    """P1 and, if only pipelines are wanted, P7."""
    ok = platform_ok(options)
    return ok & is_pipeline(F.col("command"), F.col("pipeline")) if options.pipeline_only else ok
