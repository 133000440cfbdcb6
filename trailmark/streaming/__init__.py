"""Streams: the same log reduction and refresh, fed as files arrive.

No watermark is set: rows count however late they come, as they do when the
whole report is read again, and the state is one row per phone and screen.
"""
