"""What a fresh copy may replace: placeholders, wiped texts, limits on losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import guard_norm

# Placeholder texts (in normal form) and limits.
ACCOUNT_STUBS = {"аккаунт удален": "deleted", "аккаунт заморожен": "frozen"}
POST_TITLES = ("статья удалена", "пост удален", "материал удален", "запись удалена")
POST_TEXTS = ("этот материал был удален", "статья удалена", "материал удален")
COMMENT_STUBS = {"комментарий недоступен": "unavailable", "комментарий удален модератором": "moderator", "комментарий удален автором поста": "removed", "комментарий удален": "removed"}
COMMENTS_LIMIT = 20


def loss_limit(archived: Column) -> Column:
    """How many posts may vanish in one batch: 3 to 10, a tenth of the archive in between."""
    return F.greatest(F.lit(3), F.least(F.ceil(archived / 10), F.lit(10)))


def _looked_up(value: Column, table: dict[str, str], other: Column) -> Column:
    out = None
    for text, state in table.items():
        out = F.when(value == text, state) if out is None else out.when(value == text, state)
    return out.otherwise(other)


def account_problem(p: Column) -> Column:
    """deleted, frozen or null. A placeholder name counts only without nickname and address."""
    bare = (F.coalesce(p["nickname"], F.lit("")) == "") & (F.coalesce(p["uri"], F.lit("")) == "")
    name = _looked_up(guard_norm(p["name"]), ACCOUNT_STUBS, F.lit(None))
    return F.when(F.coalesce(p["isRemovedByUserRequest"], F.lit(False)), "deleted").when(F.coalesce(p["isFrozen"], F.lit(False)), "frozen").when(bare, name)


def post_stub(title: Column, text: Column, blocks: Column, removed: Column) -> Column:
    """removed if the post is only a placeholder: flagged, or at most two blocks with a placeholder title or text."""
    starts = F.lit(False)
    for known in POST_TEXTS:
        starts |= F.startswith(guard_norm(text), F.lit(known))
    return F.when(F.coalesce(removed, F.lit(False)) | ((blocks <= 2) & (guard_norm(title).isin(*POST_TITLES) | starts)), "removed")


def post_wiped(old_weight: Column, new_weight: Column, blocks: Column, title: Column, text: Column) -> Column:
    """Weight is text length plus 150 a medium: from 300 or more to under a fifth, with few blocks or a word of deletion."""
    said = F.contains(guard_norm(title), F.lit("удал")) | F.contains(F.left(guard_norm(text), F.lit(200)), F.lit("удал"))
    return (old_weight >= 300) & (new_weight < 0.2 * old_weight) & ((blocks <= 3) | said)


def comment_stub(text: Column, has_media: Column, flags: dict[str, Column]) -> Column:
    """Why a comment is a placeholder, else null: the text decides, flags (moderator, hidden, author_deleted, author_frozen, removed) explain."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    known = guard_norm(raw)
    is_stub = known.isin(*COMMENT_STUBS) | ((raw == "") & ~has_media)
    why = F.when(flags["moderator"], "moderator").when(flags["hidden"], "hidden").when(flags["author_deleted"], "author-deleted").when(flags["author_frozen"], "author-frozen").when(flags["removed"], "removed")
    return F.when(is_stub, why.otherwise(_looked_up(known, COMMENT_STUBS, F.lit("removed"))))


def degraded(old_text: Column, old_stub: Column, new_text: Column, new_stub: Column, new_media: Column) -> Column:
    """Why the new comment must not replace the old one; null if it may."""
    old_n, new_n = F.length(F.trim(F.coalesce(old_text, F.lit("")))), F.length(F.trim(F.coalesce(new_text, F.lit(""))))
    wiped = F.when((old_n >= 40) & (new_n <= 3) & ~new_media, "wiped")
    return F.when(old_text.isNotNull() & old_stub.isNull(), F.coalesce(new_stub, wiped))


class MassLoss(Exception):
    """A batch would lose more than may be lost unasked."""


def assert_losses(merged: DataFrame, archived: int, kind: str = "posts") -> DataFrame:
    """merged has lost: boolean. Decided on the whole batch before anything is published; one aggregate, then the same frame."""
    lost = merged.agg(F.count_if("lost")).first()[0]
    limit = max(3, min(-(-archived // 10), 10)) if kind == "posts" else COMMENTS_LIMIT
    if lost > limit:
        raise MassLoss(f"{lost} {kind} would be lost, {limit} may be")
    return merged
