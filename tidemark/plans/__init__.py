"""The registered queries, their SQL counterparts, and the command line."""
