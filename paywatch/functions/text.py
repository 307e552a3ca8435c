"""Numbers as text, rounded on their exact value with ties to even, without grouping (SQL)."""


def places(x, digits):
    """Fixed number of decimal places."""
    return f"format_number({x}, '0{'.' + '0' * digits if digits else ''}')"


def plain(x):
    """Shortest form with at least one decimal place."""
    return f"format_number({x}, '0.0{'#' * 14}')"
