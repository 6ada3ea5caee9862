"""Words and their hashes; the functions live beside the other ones the whole library uses."""

from mailsieve.functions.bytewords import *  # noqa: F401, F403
