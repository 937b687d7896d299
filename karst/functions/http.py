"""Calls over the network from tasks are left out: executors would repeat them at every retry."""


def _out(name: str):
    def call(*args, **kwargs):
        raise NotImplementedError(f"http.{name}: a query does not call the network; fetch first, then read the result as a table")

    return call


get, head, patch, post, put, delete = map(_out, ("get", "head", "patch", "post", "put", "delete"))
