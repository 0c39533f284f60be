"""Messages as typed blocks, without noise, and as rendered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import fixed, text



def argument(args: Column, key: str) -> Column:
    """A string argument; null for what is no string."""
    v = F.try_parse_json(args)
    at = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def path_of(args: Column) -> Column:
    return F.coalesce(*(argument(args, k) for k in fixed.PATH_KEYS))


def summary_of(args: Column) -> Column:
    """path=, command= or query= and its value, else the argument names."""
    names = F.array_join(F.json_object_keys(args), ", ")
    return F.coalesce(*(F.concat(F.lit(f"{k}="), v) for k, v in (("path", path_of(args)), ("command", argument(args, "command")), ("query", argument(args, "query")))), names, F.lit(""))


def content_bearing(args: Column) -> Column:
    """Whether a call writes something to a path: content, edits, or old or new text without edits."""
    edits = F.try_variant_get(F.try_parse_json(args), "$.edits", "variant")
    listed = F.try_variant_get(F.try_parse_json(args), "$.edits", "array<variant>")
    filled = lambda k: F.coalesce(argument(args, k) != "", F.lit(False))
    objects = F.coalesce((F.size(listed) > 0) & F.forall(listed, lambda e: F.schema_of_variant(e).startswith("OBJECT")), F.lit(False))
    return path_of(args).isNotNull() & (filled("content") | objects | (edits.isNull() & (filled("oldText") | filled("newText"))))


def written_text(args: Column, most: int = fixed.INDEXED_CHARS) -> Column:
    """What a content-bearing call writes, as far as it is indexed: each text up to ``most``, edits' sides up to half of it."""
    edits = F.try_variant_get(F.try_parse_json(args), "$.edits", "array<struct<oldText:string,newText:string>>")
    half = lambda c: F.when(c.isNotNull(), F.concat(F.substring(c, 1, most // 2), F.lit("\n"))).otherwise("")
    whole = lambda k: F.when(argument(args, k).isNotNull(), F.concat(F.substring(argument(args, k), 1, most), F.lit("\n"))).otherwise("")
    sides = F.flatten(F.transform(edits, lambda e: F.array(half(e["oldText"]), half(e["newText"]))))
    listed = F.aggregate(sides, whole("content"), lambda a, s: F.when(F.char_length(a) < most, F.concat(a, s)).otherwise(a))
    plain = F.concat(whole("content"), whole("oldText"), whole("newText"))
    return F.when(content_bearing(args), F.substring(F.coalesce(listed, plain), 1, most)).otherwise("")


def normalize(messages: DataFrame) -> DataFrame:
    """(session_id, message_index, part_idx, kind, text, name, args, is_error, command, output): blocks in order.

    A user's message is its text and a block for each image, or one empty block; an assistant's has a block for each
    text, thinking or call; other roles than the four have none.
    """
    shape = "struct<kind:string,text:string,name:string,args:string,is_error:boolean,command:string,output:string>"

    def block(kind, text_=F.lit(None), name=F.lit(None), args=F.lit(None), is_error=F.lit(None), command=F.lit(None), output=F.lit(None)) -> Column:  # noqa: B008
        return F.struct(F.lit(kind).alias("kind"), text_.alias("text"), name.alias("name"), args.alias("args"), is_error.alias("is_error"), command.alias("command"), output.alias("output")).cast(shape)

    parts = F.coalesce("parts", F.filter("parts", lambda p: F.lit(False)))
    clean = text.sanitize(F.col("text"))
    images = F.transform(F.filter(parts, lambda p: p["type"] == "image"), lambda p: block("user", F.concat(F.lit("[image: "), F.coalesce(p["mime_type"], F.lit("undefined")), F.lit("]"))))
    none = F.array().cast(f"array<{shape}>")
    said = F.when(clean != "", F.array(block("user", clean))).otherwise(none)
    user = F.concat(said, F.coalesce(images, none))
    user = F.when(F.size(user) > 0, user).otherwise(F.array(block("user", F.lit(""))))
    own = F.transform(
        F.filter(parts, lambda p: p["type"].isin("text", "thinking", "toolCall")),
        lambda p: F.when(p["type"] == "text", block("assistant", text.sanitize(p["text"]))).when(p["type"] == "thinking", block("thinking", text.sanitize(p["thinking"]))).otherwise(block("tool_call", name=p["name"], args=p["arguments"])),
    )
    found = (
        F.when(F.col("role") == "user", user)
        .when(F.col("role") == "assistant", F.coalesce(own, none))
        .when(F.col("role") == "toolResult", F.array(block("tool_result", clean, F.col("tool_name"), is_error=F.col("is_error"))))
        .when(F.col("role") == "bashExecution", F.array(block("bash", command=F.coalesce("command", F.lit("")), output=F.coalesce("output", F.lit("")))))
        .otherwise(none)
    )
    return messages.select("session_id", "message_index", "entry_id", F.posexplode(found).alias("part_idx", "b")).select("session_id", "message_index", "entry_id", "part_idx", "b.*")


def without_noise(blocks: DataFrame) -> DataFrame:
    """No thinking, no tools and phrases that say nothing, no wrapper elements in what the user says."""
    said = text.trim(F.col("text"))
    phrase = F.lit(False)
    for p in fixed.NOISE_PHRASES:
        phrase = phrase | said.contains(p)
    cleaned = text.trim(text.strip_wrappers(said))
    is_user = F.col("kind") == "user"
    tool = F.col("kind").isin("tool_call", "tool_result") & F.coalesce(F.col("name").isin(*fixed.NOISE_TOOLS), F.lit(False))
    kept = blocks.filter((F.col("kind") != "thinking") & ~tool & ~(is_user & (phrase | (cleaned == ""))))
    return kept.withColumn("text", F.when(is_user, cleaned).otherwise(F.col("text")))


def rendered(messages: DataFrame, full: bool = False) -> DataFrame:
    """(session_id, pos, entry_id, role, summary, files): a row for each message; texts are clipped unless ``full``."""
    cut = (lambda c, n: c) if full else text.clip
    calls = F.filter("parts", lambda p: p["type"] == "toolCall")
    tools = F.array_join(F.transform(calls, lambda p: F.concat(F.coalesce(p["name"], F.lit("")), F.lit("("), summary_of(p["arguments"]), F.lit(")"))), ", ")
    files = F.filter(F.transform(calls, lambda p: path_of(p["arguments"])), lambda p: p.isNotNull())
    said = F.col("text")
    bash = cut(F.concat(F.lit("$ "), F.coalesce("command", F.lit("")), F.lit("\n"), F.coalesce("output", F.lit(""))), 300)
    result = F.concat(F.when(F.col("is_error"), "ERROR ").otherwise(""), F.lit("["), F.coalesce("tool_name", F.lit("undefined")), F.lit("] "), cut(said, 200))
    assistant = F.when(F.coalesce(tools, F.lit("")) != "", F.concat(tools, F.lit("\n"), cut(said, 300))).otherwise(cut(said, 300))
    role = F.when(F.col("role") == "user", "user").when(F.col("role") == "toolResult", "tool_result").when(F.col("role") == "bashExecution", "bash").otherwise("assistant")
    summary = F.when(F.col("role") == "user", cut(said, 300)).when(F.col("role") == "toolResult", result).when(F.col("role") == "bashExecution", bash).otherwise(assistant)
    return messages.select("session_id", F.col("message_index").alias("pos"), "entry_id", role.alias("role"), summary.alias("summary"), F.coalesce(files, F.array().cast("array<string>")).alias("files"))


def search_documents(messages: DataFrame, mode: str = "hybrid") -> DataFrame:
    """(session_id, pos, entry_id, role, text, hay): what is searched; ``file`` mode has only what calls write."""
    calls = F.filter("parts", lambda p: p["type"] == "toolCall")
    written = F.array_join(F.filter(F.transform(calls, lambda p: written_text(p["arguments"])), lambda t: t != ""), "\n")
    written = F.coalesce(written, F.lit(""))
    is_bash = F.col("role") == "bashExecution"
    bash = F.concat_ws(" ", F.coalesce("command", F.lit("")), F.coalesce("output", F.lit("")))
    body = F.when(is_bash, F.lit("") if mode == "file" else bash).otherwise(written if mode == "file" else F.concat(F.col("text"), F.when(written != "", F.concat(F.lit("\n"), written)).otherwise("")))
    base = rendered(messages).select("session_id", "pos", F.col("role").alias("_role"), "files")
    rows = messages.select("session_id", F.col("message_index").alias("pos"), "entry_id", body.alias("text")).join(base, ["session_id", "pos"])
    rows = rows.filter("text <> ''") if mode == "file" else rows
    return rows.select("session_id", "pos", "entry_id", F.col("_role").alias("role"), "text", F.concat_ws(" ", "_role", "text", F.array_join("files", " ")).alias("hay"))


def written_files(messages: DataFrame) -> DataFrame:
    """(session_id, pos, part_idx, tool, path, args): the calls that write something."""
    calls = messages.select("session_id", F.col("message_index").alias("pos"), F.posexplode("parts").alias("part_idx", "p")).filter("p.type = 'toolCall'")
    return calls.select("session_id", "pos", "part_idx", F.col("p.name").alias("tool"), path_of(F.col("p.arguments")).alias("path"), F.col("p.arguments").alias("args")).filter(content_bearing(F.col("args")))
