"""Word lists, patterns, caps and texts that results depend on."""

from __future__ import annotations

#: Query words that carry no meaning (fixed values).
QUERY_STOPWORDS = frozenset(
    """the a an is are was were be been being have has had do does did will would could should may might can shall of in
    to for with on at from by as into through during before after above below between out off over under again further
    then once here there when where why how all both each few more most other some such no nor not only own same so than
    too very just about it its that this what which who whom these those""".split()
)

#: Words that do not count toward a brief line's budget (fixed values).
BRIEF_STOPWORDS = frozenset(
    """a an the is are was were be been being have has had do does did will would could should may might shall can need
    must to of in for on with at by from as into through during before after above below between under over and but or
    nor not so yet both either neither each every all any few more most other some such no that this these those it its i
    me my we our you your he him his she her they them their who which what if then than when where how just also""".split()
)

#: Tools and phrases that say nothing about a session, and tags that wrap what a host has added (fixed values).
NOISE_TOOLS = ("TodoWrite", "TodoRead", "ToolSearch", "WebSearch", "AskUser", "ExitSpecMode", "GenerateDroid")
NOISE_PHRASES = ("Continue from where you left off.", "No response requested.", "IMPORTANT: TodoWrite was not called yet.")
WRAPPER_TAGS = ("system-reminder", "ide_opened_file", "command-message", "context-window-usage")

#: Argument keys that hold a path, in order of preference (fixed values).
PATH_KEYS = ("path", "file_path", "filePath", "file")
READ_TOOLS = ("Read", "read_file", "View")
WRITE_TOOLS = ("Edit", "Write", "edit", "write", "edit_file", "write_file", "MultiEdit")
SUMMARY_FIELDS = {"Read": "file_path", "Edit": "file_path", "Write": "file_path", "read": "path", "edit": "path", "write": "path", "Glob": "pattern", "Grep": "pattern"}

#: Patterns, for Java's regular expressions (fixed values).
ANSI = "\x1b\\[[0-9;]*[A-Za-z]"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
SELF_TALK = r"(?i)^(?:\s*(?:hmm|wait|actually|oh|okay|ok|well|so)[,.!\s-]+){1,2}"
SCOPE_CHANGE = r"(?i)\b(instead|actually|change of plan|forget that|new task|switch to|now I want|pivot|let'?s do|stop .* and)\b"
TASK = r"(?i)\b(fix|implement|add|create|build|refactor|debug|investigate|update|remove|delete|migrate|deploy|test|write|set up)\b"
SHORT_NOISE = r"(?i)^(ok|yes|no|sure|yeah|yep|go|hi|hey|thx|thanks|ok\b.*|y|n|k)\s*[.!?]*$"
NOT_A_GOAL = r"^\s*[\[│├└─╭╰]|```|^\s*(=[A-Z]+\(|function |const |let |var |import |export |class )|^(https?:|file:|/[A-Za-z])|\\n|^\s*For each\b|\bin full\b[^\n]*\b(comments|issue|issues|PRs?|linked)\b"
TEMPLATE_START = r"(?i)^\s*(For each\b|Do NOT implement\b|Analyze and propose\b|If Task/context\b|Output:\s*$)"
PREFERENCES = (
    r"(?i)\bprefer(?:s|red|ring)?\s+\w",
    r"(?i)\bdon'?t want\b",
    r"(?i)\balways (?:use|do|run|prefer|keep|make|format|write|add|set|put|prefix|start|include|append)\b",
    r"(?i)\bnever (?:use|do|run|push|commit|write|ignore|add|set|put|remove|delete|include|deploy)\b",
    r"(?i)\bplease (?:use|avoid|keep|make|don'?t|do not|format|write)\b",
    r"(?i)\b(?:style|format|language|naming)\s*[:=]\s*\S",
)
BLOCKER = r"(?i)\b(fail(ed|s|ure|ing)?|broken|cannot|can't|won't work|does not work|doesn't work|still (broken|failing|wrong)|blocked|blocker|not (fixed|resolved|working)|crash(es|ed|ing)?)\b"
COMMIT_MESSAGE = r"""git\s+commit[^\n]*?-m\s+(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|\$?'((?:[^'\\]|\\.)*)')"""
COMMIT_HASHES = (r"\[\S+\s+([0-9a-f]{7,12})\]", r"\b[0-9a-f]{7,12}\.\.([0-9a-f]{7,12})\b", r"\b([0-9a-f]{8,12})\b")
PIPE_TAIL = r"(?:\s*\|\s*(?:head|tail|sort|wc|column|tr|cut|uniq)(?:\s[^|]*)?){1,10}$"
SKILL_BLOCK = r"""<skill\s+name="([^"]+)"[^>]*>(?s:.*?)(?:</skill>|$)"""
RETRYABLE = (
    r"(?i)overloaded|provider.?returned.?error|rate.?limit|too many requests|429|500|502|503|504|service.?unavailable|server.?error|internal.?error|network.?error|connection.?error"
    r"|connection.?refused|connection.?lost|websocket.?closed|websocket.?error|other side closed|fetch failed|upstream.?connect|reset before headers|socket hang up|ended without"
    r"|http2 request did not get a response|timed? out|timeout|terminated|retry delay"
)
REGEX_SIGNS = set("|*+?{}()[]\\^$.")

#: Caps (fixed values).
GOALS, PREFERENCE_LINES, MERGED_PREFERENCES, COMMITS, FILES, BLOCKERS = 8, 10, 15, 8, 10, 5
TAIL_BLOCKS, TOOL_LINES, BRIEF_LINES, LINE_WIDTH = 20, 8, 120, 120
BRIEF_USER_WORDS, BRIEF_ASSISTANT_WORDS, BASH_CHARS = 256, 200, 120
PAGE, RECENT, PREVIEW_LINES, FULL_CHARS, INDEXED_CHARS, RECORD_CHARS = 5, 25, 30, 50 * 1024, 10_240, 10_000
BM25_K, BM25_B = 1.2, 0.75

#: Sections of a summary, in order, and what closes it (fixed values).
SECTIONS = ("Session Goal", "Files And Changes", "Commits", "Outstanding Context", "User Preferences")
SEPARATOR = "\n\n---\n\n"
RECALL_NOTE = (
    "The conversation before this point has been compacted into the summary above. "
    "Details not captured here — exact code, error messages, file paths — are only recoverable via `recall`. "
    "Use `recall` to search the session history. Do not redo work already completed."
)

#: What closes a text of memories: with memories in it, and without (fixed values).
MEMORY_NOTE = """----
Bracketed ids in reflections and observations connect to their source session entries. These are condensed memories from earlier in this session.
When entries conflict, the most recent observation reflects the latest known state.
Use `recall` with an id to retrieve original context, or `#N:path` drill-down to explore file content from referenced entries.
When exact source context is needed for precision or traceability, use the `recall` tool with the relevant observation or reflection id. This is especially useful when a reflection materially affects a decision or is too compressed to continue confidently.
----"""
RECALL_HINT = """----
Use `recall` with an id to retrieve original context, or `#N:path` drill-down to explore file content from referenced entries.
When entries conflict, the most recent entry reflects the latest known state.
----"""

#: Source entries of a log, and the custom types of memory events (fixed values).
SOURCE_TYPES = ("message", "custom_message", "branch_summary")
OBSERVED, REFLECTED, DROPPED = "om.observations.recorded", "om.reflections.recorded", "om.observations.dropped"
RELEVANCE = ("low", "medium", "high", "critical")
TIERS = ("none", "partial", "strong")
