from parleo.plans.skew import (  # noqa: F401
    attach, dim, exact_quantile, islands, lookahead, salted_join, scan, with_halo,
)
