"""Column expressions: identifiers, money, names, dates, text and rectangles."""
