"""Errors that callers can tell apart, with a message for users and hints."""

from __future__ import annotations


class LexigroveError(Exception):
    """Base error: a code, a message for users, context and suggestions."""

    code = "error"

    def __init__(self, message: str, *, code: str | None = None, user_message: str | None = None, context: dict | None = None, suggestions: list[str] | None = None):
        super().__init__(message)
        self.code = code or self.code
        self.user_message = user_message or message
        self.context = dict(context or {})
        self.suggestions = list(suggestions or [])

    def details(self) -> str:
        """Everything, the cause included, on one line each."""
        lines = [f"{self.code}: {self}"] + [f"{k}={v}" for k, v in sorted(self.context.items())]
        return "\n".join(lines + ([f"cause: {self.__cause__}"] if self.__cause__ else []))


class CorpusNotFound(LexigroveError):
    code = "corpus_not_found"


class CorpusUnreadable(LexigroveError):
    code = "corpus_unreadable"


class QueryError(LexigroveError):
    code = "invalid_query"


class ConfigError(LexigroveError):
    code = "invalid_config"


def user_message(error: Exception) -> str:
    """What to tell a user about any error."""
    return error.user_message if isinstance(error, LexigroveError) else f"Unexpected problem: {error}"
