"""One writer for each index: a lock file with the holder's process, or on shared storage a lease that its holder renews."""

from __future__ import annotations

import json
import os
import socket
import threading
import time
import uuid


class IndexLock:
    def __init__(self, folder: str):
        self.path, self.held = os.path.join(folder, "index.lock"), False

    def _stale(self) -> bool:
        try:
            with open(self.path) as f:
                owner = json.load(f)
        except (OSError, ValueError):
            return True
        if owner.get("host") != socket.gethostname():
            return False
        try:
            os.kill(owner["pid"], 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            return False
        return False

    def acquire(self) -> bool:
        """Whether this process is now the writer; a lock whose process has ended is taken over."""
        if self.held:
            return True
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        for _ in range(2):
            try:
                handle = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                if not self._stale():
                    return False
                try:
                    os.unlink(self.path)
                except FileNotFoundError:
                    pass
                continue
            with os.fdopen(handle, "w") as f:
                json.dump({"pid": os.getpid(), "host": socket.gethostname()}, f)
            self.held = True
            return True
        return False

    def release(self) -> None:
        if self.held:
            self.held = False
            try:
                os.unlink(self.path)
            except FileNotFoundError:
                pass


class SharedLock:
    """A lease on any file system that Hadoop reaches: whoever creates the file first holds it, and renews it as long as it lives.

    A lease that wasn't renewed for ``lease`` seconds, by the file system's own times, is taken over.
    """

    def __init__(self, spark, folder: str, lease: float = 60.0):
        self.spark, self.lease, self.held, self.owner = spark, lease, False, uuid.uuid4().hex
        self.path = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/index.lease")
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._stop = threading.Event()

    def _create(self) -> bool:
        try:
            out = self.fs.create(self.path, False)  # fails where the file is there already
            out.write(bytearray(self.owner.encode()))
            out.close()
            return True
        except Exception:  # of the Java side: somebody else was first
            return False

    def _content(self) -> str | None:
        try:
            stream = self.fs.open(self.path)
            got = bytes(stream.readAllBytes()).decode()
            stream.close()
            return got
        except Exception:
            return None

    def acquire(self) -> bool:
        if self.held:
            return True
        if not self._create():
            try:
                age = time.time() - self.fs.getFileStatus(self.path).getModificationTime() / 1000
            except Exception:
                age = 0.0
            if age <= self.lease:
                return False
            self.fs.delete(self.path, False)
            if not self._create():
                return False
        self.held = True
        self._stop.clear()
        threading.Thread(target=self._renew, daemon=True).start()
        return True

    def _renew(self) -> None:
        while not self._stop.wait(self.lease / 4):
            if self._content() != self.owner:  # taken over, after a pause longer than the lease
                self.held = False
                return
            try:
                self.fs.setTimes(self.path, int(time.time() * 1000), -1)
            except Exception:
                continue

    def release(self) -> None:
        if self.held:
            self.held = False
            self._stop.set()
            if self._content() == self.owner:
                self.fs.delete(self.path, False)
