"""Character tables. They never follow a runtime's own Unicode tables."""

DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BASE36 = DIGITS + UPPER

#: White space that canonicalization removes, by code point.
WHITESPACE_CODES = (
    0x0009, 0x000A, 0x000B, 0x000C, 0x000D, 0x0020, 0x0085, 0x00A0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)
WHITESPACE = "".join(map(chr, WHITESPACE_CODES))

#: White space that kind and country tokens are trimmed of.
ASCII_WHITESPACE = "\t\n\x0b\x0c\r "
