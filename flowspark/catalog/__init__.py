"""The registered queries: each operator applied to whole tables, with its SQL counterpart."""
