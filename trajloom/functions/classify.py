"""What kind of step a tool call is: investigate, implement or neutral. All are Column to Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajloom.functions.strict import strict
from trajloom.functions.text import WHITE, once, trim_white

INVESTIGATE, IMPLEMENT, NEUTRAL = "investigate", "implement", "neutral"

# Tool names of the first agent.
CLAUDE_INVESTIGATE = ["Read", "Grep", "Glob", "WebFetch", "WebSearch", "Task"]
CLAUDE_IMPLEMENT = ["Edit", "Write", "NotebookEdit"]
# Base names of the second agent's tools, in lower case.
CODEX_INVESTIGATE = ["read_file", "read", "list_dir", "ls", "grep", "search", "find", "glob"]
CODEX_IMPLEMENT = ["apply_patch", "edit", "write", "write_file", "replace"]
SHELL_TOOLS = ["bash", "shell", "exec", "exec_command", "unified-exec", "unified_exec", "functions.exec_command"]
# Hook events.
RESET_EVENTS = ["SessionStart", "PostCompact"]
SUBAGENT_EVENTS = ["SubagentStart", "SubagentStop"]
# Commands that only read, and the flags that make one of them write.
READING = ["cat", "less", "head", "grep", "rg", "fd", "ls", "wc"]
READING_WITHOUT = {
    "tail": ["-f", "--follow"],
    "find": ["-delete", "-exec", "-execdir", "-ok", "-okdir"],
    "curl": ["-o", "--output", "-O", "--remote-name", "-T", "--upload-file"],
    "wget": ["-O", "--output-document", "-P", "--directory-prefix"],
}
READING_GIT = ["status", "diff", "log", "show", "grep"]


def is_reset(event: Column) -> Column:
    return F.coalesce(event.isin(*RESET_EVENTS), F.lit(False))


def is_subagent(event: Column) -> Column:
    return F.coalesce(event.isin(*SUBAGENT_EVENTS), F.lit(False))


def is_tool_call(event: Column) -> Column:
    return F.coalesce(event == "PostToolUse", F.lit(False))


def route_event(event: Column) -> Column:
    """reset, tool_call, usage_tick, end, subagent or ignored."""
    return (
        F.when(is_reset(event), "reset").when(is_tool_call(event), "tool_call").when(event.isin("Stop", "UserPromptSubmit"), "usage_tick")
        .when(event == "SessionEnd", "end").when(is_subagent(event), "subagent").otherwise("ignored")
    )


def claude_tool_class(tool: Column) -> Column:
    return F.when(tool.isin(*CLAUDE_INVESTIGATE), INVESTIGATE).when(tool.isin(*CLAUDE_IMPLEMENT), IMPLEMENT).otherwise(NEUTRAL)


def codex_tool_base_name(tool: Column) -> Column:
    """Trimmed, lower case, what follows the last of . / :"""
    return F.regexp_extract(F.lower(trim_white(tool)), "[^./:]*$", 0)


def codex_tool_class(tool: Column) -> Column:
    base = codex_tool_base_name(tool)
    return F.when(base.isin(*CODEX_INVESTIGATE), INVESTIGATE).when(base.isin(*CODEX_IMPLEMENT), IMPLEMENT).otherwise(NEUTRAL)


def is_shell_tool(tool: Column) -> Column:
    return F.coalesce(F.lower(trim_white(tool)).isin(*SHELL_TOOLS), F.lit(False))


def _has_flag(words: Column, flags: list[str]) -> Column:
    """A flag by itself, or as flag=value."""
    return F.exists(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: reduce(lambda a, b: a | b, [(w == f) | w.startswith(f + "=") for f in flags]))


def classify_command(command: Column) -> Column:
    """investigate where a command certainly only reads, else neutral; never implement."""
    return once(trim_white(command), lambda text: once(F.split(text, f"[{WHITE}]+"), lambda words: _classified(text, words)))


def _classified(text: Column, words: Column) -> Column:
    first, second = F.element_at(words, 1), F.try_element_at(words, F.lit(2))
    reading = first.isin(*READING)
    for name, flags in READING_WITHOUT.items():
        reading = reading | ((first == name) & ~_has_flag(words, flags))
    reading = reading | ((first == "git") & F.coalesce(second.isin(*READING_GIT), F.lit(False)))
    rest = F.slice(words, 3, F.greatest(F.size(words), F.lit(1)))
    listing = F.array_position(rest, "-list")
    listed = F.exists(rest, lambda w: w.startswith("-list=") & (F.length(w) > 6)) | ((listing > 0) & (listing < F.size(rest)))
    reading = reading | ((first == "go") & F.coalesce(second == "test", F.lit(False)) & listed)
    joined = text.rlike(r"[\n\r;&|<>`]|\$\(")
    return F.when(text.isNull() | (text == "") | joined, NEUTRAL).when(reading, INVESTIGATE).otherwise(NEUTRAL)


def shell_command(tool_input: Column) -> Column:
    """``command``, else ``cmd``, of the JSON input, trimmed; null where empty, or where either is no string."""
    of = lambda x: F.nullif(trim_white(x), F.lit(""))
    return once(strict(tool_input, {"command": "string", "cmd": "string"}), lambda asked: F.coalesce(of(asked["command"]), of(asked["cmd"])))


def codex_phase_class(tool: Column, tool_input: Column) -> Column:
    return (
        F.when(is_shell_tool(tool), once(shell_command(tool_input), lambda x: F.when(x.isNull(), NEUTRAL).otherwise(classify_command(x))))
        .when(F.lower(trim_white(tool)).startswith("mcp__"), NEUTRAL).otherwise(codex_tool_class(tool))
    )
