"""Source-to-sink passes: does request data reach a call that executes, includes or writes?"""
