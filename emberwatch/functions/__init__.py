"""Column expressions; all of them native, none needs a Python worker."""
